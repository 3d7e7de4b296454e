"""Secret scans: candidates by pattern, false positives removed by a random forest (operator 4)."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.forest import Forest
from quillspark.llm.storage import table

#: A run of key-like characters with a digit or behind an assignment.
RUN = re.compile(r"[A-Za-z0-9_+/=\-.]{12,}")
ASSIGNED = re.compile(r"[:=]\s*[\"'`]?$")
#: Any value, of any length and characters, that is assigned to a secret's name, follows a scheme or stands in a link.
#: Each run of a name's characters is tried once, from its start, and nothing is read twice, so a text takes time that
#: grows with its length.
VALUE = re.compile(
    r"(?<![\w-])(?=[\w-]*?(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|auth|credentials?))"
    r"[\w-]++[\"'`\])]{0,3}\s{0,3}(?:=>|:=|={1,3}|:)\s{0,3}"
    r"(?:\"(?P<double>[^\"\n]++)\"|'(?P<single>[^'\n]++)'|`(?P<back>[^`\n]++)`|(?P<bare>[^\s\"'`,;]++))"
    r"|\b(?:bearer|basic)\s{1,3}(?P<scheme>[A-Za-z0-9._~+/=-]++)"
    r"|://[^/\s:@]*+:(?P<link>[^/\s@]++)@",
    re.I,
)
#: Characters of the text before and behind a candidate that are looked at.
NEAR = 60
#: Labelled findings that the forest is trained on.
FINDINGS = 4000
#: Words near secrets, words near identifiers that are none, and common words of identifiers.
SECRET_WORDS = frozenset("token key apikey secret password passwd pwd auth authorization bearer credential credentials access private client".split())
OTHER_WORDS = frozenset(
    "commit sha md5 sha1 sha256 checksum digest hash uuid guid id revision etag build version image example sample placeholder test "
    "url link path file isbn order invoice none null true false required optional enter reset forgot minimum characters str string".split()
)
DICTIONARY = frozenset(
    "about above after again all also and any are back because been before being between both build but call can change class code come "
    "config could data day default did does down each even example file find first for from function get give good great has have here "
    "home how image import index into its just key last like line list local long look made main make many may more most much must name "
    "new not now number only other our out over page part path people place point public right same script see server service should "
    "show site small some static such system take test than that the them then there these they thing think this time token two under "
    "use user value very want was way well were what when where which while who will with work world would write year your".split()
)
FORMATS = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|sk_test_|pk_live_|xox[abp]-|AIza|glpat-|npm_|eyJ)")


#: Signs of a value that stands for another one.
PLACEHOLDER = re.compile(r"^[\W_]*$|^(.)\1*$|x{4,}|\*{3,}|\.{3}|^[<{\[$%]|[>}\]%]$|[(]|change_?me|your|example|placeholder|redacted|dummy|insert|todo|environ|getenv")


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(v / n * math.log2(v / n) for v in Counter(text).values())


def coverage(text: str) -> float:
    """Share of the letters that dictionary words of three letters or more cover, longest first from the left."""
    low = re.sub(r"[^a-z]", " ", text.lower())
    letters = sum(c != " " for c in low)
    covered = at = 0
    while at < len(low):
        size = next((k for k in range(min(10, len(low) - at), 2, -1) if low[at : at + k] in DICTIONARY), 0)
        covered += size
        at += size or 1
    return covered / letters if letters else 0.0


def features(candidate: str, before: str, path: str, behind: str = "") -> list[float]:
    """Numbers that describe a candidate, the words before and behind it and the path or source it comes from."""
    n = len(candidate)
    kinds = [_kind(c) for c in candidate]
    changes = Counter(zip(kinds, kinds[1:], strict=False))
    near = re.findall(r"[a-z0-9]+", before.lower())[-6:]
    parts = {p for w in near for p in (w, *w.split("_"))}
    after = set(re.findall(r"[a-z0-9]+", behind.lower())[:4])
    low = candidate.lower()
    vowels = sum(c in "aeiou" for c in low)
    letters = sum(c.isalpha() for c in candidate)
    return [
        n,
        _entropy(candidate),
        sum(v for (a, b), v in changes.items() if a != b) / max(1, n - 1),
        changes[0, 2] / n,
        changes[2, 0] / n,
        changes[0, 1] / n,
        changes[0, 0] / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", candidate))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        coverage(candidate),
        vowels / max(1, letters),
        float(len(parts & SECRET_WORDS)),
        float(len(parts & OTHER_WORDS)),
        float(bool(ASSIGNED.search(before))),
        float(bool(FORMATS.match(candidate))),
        candidate.count("/") + candidate.count("."),
        len(set(low)) / n,
        float(bool(re.search(r"test|example|doc|sample|readme", path.lower()))),
        float(bool(re.search(r"\.env|config|settings|secret|credential", path.lower()))),
        float(len(after & SECRET_WORDS)),
        float(len(after & OTHER_WORDS)),
        float(bool(re.search(r"[\"'`]$", before))),
        float(len({k for k in kinds})),
        float(bool(PLACEHOLDER.search(low))),
        float(len(set(re.findall(r"[a-z]+", low)) & (OTHER_WORDS | SECRET_WORDS))),
        letters / n,
    ]


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, candidate) in order: values of secrets' names, schemes and links, of any length, and key-like runs that
    have a digit or are assigned to something."""
    out = []
    for m in VALUE.finditer(text):
        value = m[m.lastgroup]
        bare = value.rstrip(").]}>") if m.lastgroup == "bare" and not PLACEHOLDER.search(value.lower()) else value
        if bare:
            out.append((m.start(m.lastgroup), bare))
    held = [(a, a + len(x)) for a, x in out]
    k = 0
    for m in RUN.finditer(text):
        found = m[0]
        lead = len(found) - len(found.lstrip("=.-/+"))
        found = found.strip("=.-/+") if not found.endswith("==") else found[lead:].rstrip(".-/+")
        start = m.start() + lead
        while k < len(held) and held[k][1] <= start:
            k += 1
        if len(found) < 12 or (k < len(held) and held[k][0] < start + len(found)):
            continue
        if any(c.isdigit() for c in found) or ASSIGNED.search(text[max(0, start - 8) : start]):
            out.append((start, found))
    return sorted(out)


def described(text: str, path: str) -> list[tuple[int, str, list[float]]]:
    """(start, candidate, features) of a text's candidates."""
    out = []
    for start, found in candidates(text):
        end = start + len(found)
        out.append((start, found, features(found, text[max(0, start - NEAR) : start], path, text[end : end + NEAR])))
    return out


def labelled_findings(count: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, tuple[int, int] | None]]:
    """(text, path, (start, length) of its secret or None) made by rule, half with a secret.

    Secrets are random keys of common shapes and short passwords in contexts that name them; the others are digests,
    UUIDs, version strings, paths, links, addresses, long numbers, placeholders, references and words.
    """
    rng = random.Random(seed)
    low, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    mixed = low + low.upper() + "0123456789"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: rng.choice(sorted(DICTIONARY)) if rng.random() < 0.5 else some(low, rng.randint(2, 9))
    words = lambda n: " ".join(word() for _ in range(n))

    def password() -> str:
        """A word or two in odd letters, digits and signs, as people choose them."""
        base = "".join(rng.choice([c, c, c.upper(), {"a": "4", "e": "3", "o": "0", "i": "1", "s": "5"}.get(c, c)]) for c in word() + rng.choice(["", word()]))
        return base + some("0123456789", rng.randint(1, 4)) + rng.choice(["", "!", "#", "&3", "$$", "!@#"])

    out = []
    for k in range(count):
        quote = rng.choice(['"', "'", "", '"'])
        if k % 2:
            secret = rng.choice(
                [
                    lambda: some(hexes, rng.choice([32, 40, 40, 48, 64])),
                    lambda: some(mixed, rng.randint(20, 64)),
                    lambda: "AKIA" + some(low.upper() + "0123456789", 16),
                    lambda: rng.choice(["ghp_", "sk_live_", "sk-", "glpat-", "npm_"]) + some(mixed, rng.randint(24, 40)),
                    lambda: some(mixed + "+/", 43) + "=",
                    lambda: "eyJ" + some(mixed, 33) + "." + some(mixed, 40) + "." + some(mixed + "-_", 43),
                    lambda: some(mixed + "-_", rng.randint(14, 24)),
                    lambda: some(mixed + "!@#$%^&*", rng.randint(8, 16)),
                    password,
                    password,
                ]
            )()
            name = rng.choice(["token", "api_key", "secret", "password", "access_key", "auth", "client_secret", "apikey", "private_key"])
            before = f"{words(4)} {name}{rng.choice([' = ', '=', ': ', ' : '])}{quote}"
            if FORMATS.match(secret) and rng.random() < 0.5:
                before = words(5) + " " + quote
            behind = quote + rng.choice(["", " ", ",", "\n"]) + rng.choice(["", words(3)])
            if rng.random() < 0.1 and len(secret) > 16:
                before, behind = f"{words(3)} authorization: bearer ", " " + words(2)
            elif rng.random() < 0.1 and not re.search(r"[/@\s]", secret):
                before, behind = f"{words(3)} {rng.choice(['postgres', 'https', 'amqp'])}://{word()}:", f"@{word()}.{word()}/{word()}"
            elif quote == "" and re.search(r"[,;]", secret):
                before, behind = before + '"', '"' + behind
            out.append((before + secret + behind, rng.choice(["", ".env", "config.py", "src7", "notes.txt"]), (len(before), len(secret))))
        else:
            number = some("0123456789", rng.randint(12, 19))
            uuid = "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12))
            candidate, before = rng.choice(
                [
                    lambda: (some(hexes, rng.choice([32, 40, 64])), f"{words(4)} {rng.choice(['commit', 'sha256', 'md5', 'checksum', 'digest', 'etag'])}{rng.choice([' ', ': ', ' = '])}"),
                    lambda: (some(hexes, rng.choice([32, 40])), words(5) + " "),
                    lambda: (uuid, f"{words(4)} {rng.choice(['id', 'uuid', 'request'])}{rng.choice([': ', '=', ' '])}"),
                    lambda: (number, f"{words(4)} {rng.choice(['order', 'card', 'phone', 'number'])} "),
                    lambda: (f"{word()}.{number[:2]}", words(5) + " "),
                    lambda: (f"{word()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}-{word()}", f"{words(3)} version "),
                    lambda: ("/".join([word(), word(), f"{word()}{rng.randint(0, 99)}", word() + ".html"]), f"{words(3)} {rng.choice(['url', 'path', 'see', 'file'])} "),
                    lambda: (rng.choice(["your_api_key_here_123", "xxxxxxxxxxxxxxxx1234", "changeme_example_key1", "test_token_placeholder_1", "INSERT_TOKEN_HERE_000"]), f"{words(3)} {rng.choice(['token', 'api_key', 'secret'])} = {quote}"),
                    lambda: (f"{word()}_{word()}_{word()}_{rng.randint(1, 999)}", f"{words(3)} {rng.choice(['key', 'name', 'set'])} = {quote}"),
                    lambda: ("".join(word() for _ in range(4))[:40] + str(rng.randint(0, 9)), words(5) + " "),
                    lambda: (f"mail{rng.randint(0, 9)}.{word()}.example.com", words(4) + " " + word() + "@"),
                    lambda: (f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", words(4) + " date "),
                    lambda: (rng.choice(STAND_INS)(word, rng), f"{words(2)} {rng.choice(['password', 'token', 'secret', 'api_key', 'auth'])}{rng.choice([': ', ' = ', '=', ' := '])}{quote}"),
                    lambda: (word(), f"{words(2)} {rng.choice(['password', 'token', 'secret', 'auth', 'credentials'])}: {quote}"),
                ]
            )()
            behind = (quote if quote and before.endswith(quote) else "") + rng.choice([" ", "\n", ", "]) + words(3)
            out.append((before + candidate + behind, rng.choice(["", "README.md", "tests/data", "src3", "index.html"]), None))
    return out


#: What stands where a secret would, made of a word.
STAND_INS = (
    lambda word, rng: "*" * rng.randint(3, 12),
    lambda word, rng: "x" * rng.randint(3, 12),
    lambda word, rng: f"<{word()}>",
    lambda word, rng: f"${{{word().upper()}_{word().upper()}}}",
    lambda word, rng: f"${word().upper()}",
    lambda word, rng: f"{{{{ {word()} }}}}",
    lambda word, rng: f"os.environ.get({word().upper()})",
    lambda word, rng: f"{word()}.{word()}()",
    lambda word, rng: rng.choice(["None", "null", "true", "false", "str", "string", "required", "optional", "changeme", "example", "redacted", "TODO", "your-password"]),
    lambda word, rng: f"YOUR_{word().upper()}_HERE",
    lambda word, rng: str(rng.randint(0, 99)),
    lambda word, rng: f"{word()}_{word()}",
)


def train_forest(findings: list[tuple[str, str, tuple[int, int] | None]] | None = None) -> Forest:
    """The forest, fitted on labelled findings (text, path, span of its secret or None), made by rule if none are given.

    Each candidate of a text is one example: a secret if it lies within the span.
    """
    x, y = [], []
    for text, path, span in labelled_findings() if findings is None else findings:
        for start, found, described_by in described(text, path):
            x.append(described_by)
            y.append(float(span is not None and start < span[0] + span[1] and span[0] < start + len(found)))
    return Forest().fit(np.array(x), np.array(y))


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, candidate, probability, is_secret), a row for each candidate of docs.

    docs has doc_id, text and source (the path).  start and length count code points.  Row-local.
    Defined results: null and empty texts have no candidates; a null source is an empty path; ids of any type, null
    too, pass unchanged; repeated rows give repeated results; a very long text is one pass over it, with a row for
    each of its candidates; an empty table gives an empty one; other columns, of any name, are not read.
    """
    forest = forest or train_forest()
    rows = docs.select("doc_id", "text", "source")
    schema = rows.select("doc_id").schema.add("start", "long").add("length", "long").add("candidate", "string").add("probability", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for k, (text, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for one in described(text or "", source or ""):
                    owner.append(k)
                    found.append(one)
            p = forest.probability(np.array([x for *_, x in found])) if found else np.zeros(0)
            starts, words = [a for a, _, _ in found], [x for _, x, _ in found]
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(starts, pa.int64()),
                pa.array([len(x) for x in words], pa.int64()),
                pa.array(words, pa.string()),
                pa.array(p),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("is_secret", F.col("probability") >= threshold)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<secret>") -> str:
    """text with the spans (start, length) replaced."""
    out, at = [], 0
    for start, length in sorted(spans):
        out += [text[at:start], mark]
        at = start + length
    return "".join([*out, text[at:]])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents and whether they are secrets."""
    return scan(table(spark, sf_dir, "documents"))
