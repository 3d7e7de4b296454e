"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from quillspark.llm.backoff import OP10_SQL, op10
from quillspark.llm.chat import op5
from quillspark.llm.exact import OP3_SQL, op3
from quillspark.llm.html_text import op9
from quillspark.llm.lattice import op7
from quillspark.llm.leaderboard import OP13_SQL, op13
from quillspark.llm.mixing import op1
from quillspark.llm.packing import op6
from quillspark.llm.pieces import op12
from quillspark.llm.repair import OP11_SQL, op11
from quillspark.llm.secrets import op4
from quillspark.llm.simhash import op8
from quillspark.llm.toxicity import op2

QUERIES = {
    "op1_mixing": op1,
    "op2_toxicity": op2,
    "op3_exact_dedup": op3,
    "op4_secrets": op4,
    "op5_chat": op5,
    "op6_packing": op6,
    "op7_embeddings": op7,
    "op8_simhash": op8,
    "op9_html": op9,
    "op10_backoff": op10,
    "op11_repair": op11,
    "op12_pieces": op12,
    "op13_leaderboard": op13,
}

#: The others have no SQL form; tests/llm holds them against brute force, round trips or held-out data.
SQL = {"op3_exact_dedup": OP3_SQL, "op10_backoff": OP10_SQL, "op11_repair": OP11_SQL, "op13_leaderboard": OP13_SQL}
