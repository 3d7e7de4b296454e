"""Change feed of a leaderboard: a stream with event-time timers over late lines (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.llm.crc import CRC_TABLE, crc32_sql
from quillspark.llm.storage import held, publish, scratch, store, table

#: Fixed values of the contract: the first day of the feed, its length in days and batches, days a line may be late,
#: places of a board.
FIRST_DAY, SPAN, BATCHES, LATE, PLACES = 19_723, 180, 8, 15, 10
DAY_MS = 86_400_000
#: The day of end sentinels, behind every line's.
END_DAY = 100_000
#: Parts, by a hash of the item, into which a nation's state is split.
PARTS = 8
#: Lines of a task that are summed up before they are shuffled.
BLOCK = 400_000
LINE = "shipped int, arrival int, nation_id int, item_id long, cents long"
BOARD = "nation_id int, part int, arrival_day long, item_id long, revenue long, shown boolean"


def batch_of(day: Column) -> Column:
    """The batch of an arrival day; days before the first count to the first batch."""
    return F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / SPAN))).cast("int")


def lines(sales: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row (LINE and batch) for each sale line; a line that does not count has no nation_id.

    Lines are not shuffled for what nearly all have, a known item: the distinct ids of lines are looked up, and the
    ids that are unknown, a stored table, are joined to the lines, sent to all tasks only while Spark's threshold allows
    it.  Lines without an amount meet their items' prices in a join of their own.  Of repeated items the least price counts,
    of repeated vendors the least nation_id.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat_ws(",", *map(text, ("sale_id", "item_id", "vendor_id", "line_no")))
    hashed = sales.select("item_id", "vendor_id", "quantity", "amount", "flag", "shipped_at", F.crc32(key).alias("h"))
    shipped = F.coalesce(F.unix_date(F.to_date("shipped_at")), (FIRST_DAY + F.col("h") % 150).cast("int"))
    timed = hashed.withColumn("shipped", shipped).withColumn(
        "arrival", (F.col("shipped") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int")
    )
    homes = vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").alias("home"))
    prices = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("price").alias("price"), F.lit(True).alias("known"))
    unknown = store(sales.where("item_id IS NOT NULL").select("item_id").distinct().join(prices, "item_id", "left_anti"), "unknown")
    told = timed.where("amount IS NOT NULL").join(unknown.withColumn("known", F.lit(False)), "item_id", "left")
    told = told.withColumns({"known": F.coalesce("known", F.col("item_id").isNotNull()), "price": F.lit(None).cast("double")})
    met = timed.where("amount IS NULL").join(prices, "item_id", "left")
    met = met.withColumn("known", F.coalesce("known", F.lit(False)))
    priced = F.col("quantity") * F.floor(100 * F.col("price") + 0.5)
    cents = F.coalesce(F.floor(100 * F.col("amount") + 0.5), priced, F.lit(0)).cast("long")
    both = told.unionByName(met).join(homes, "vendor_id", "left")
    return both.select(
        "shipped",
        "arrival",
        F.when(F.col("known"), F.col("home")).cast("int").alias("nation_id"),
        "item_id",
        F.when(F.col("flag") == "swapped", -cents).otherwise(cents).alias("cents"),
        batch_of(F.col("arrival")).alias("batch"),
    )


def _summed(keys: list[np.ndarray], cents: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of cents by distinct keys, in the keys' order."""
    order = np.lexsort(keys[::-1])
    keys, cents = [k[order] for k in keys], cents[order]
    if not len(cents):
        return keys, cents
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    return [k[new] for k in keys], np.add.reduceat(cents, np.flatnonzero(new))


def _part(items: np.ndarray, parts: int) -> np.ndarray:
    return ((items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def packed(rows: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(nation_id, part, latest, lines): lines of LINE summed up by nation, item and days within each task.

    lines are columns item, cents (8 bytes), shipped, arrival (4 bytes) of one nation and part; latest is the largest
    day of shipping among them.  Lines that do not count are a row without nation and lines, as their days count.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            counted = t.filter(t["nation_id"].is_valid())
            out = []
            if counted.num_rows < t.num_rows:
                out.append((None, 0, t.filter(t["nation_id"].is_null())["shipped"].to_numpy().max(), b""))
            nation, item, cents, shipped, arrival = (counted[c].to_numpy() for c in ("nation_id", "item_id", "cents", "shipped", "arrival"))
            (nation, part, item, shipped, arrival), cents = _summed([nation, _part(item, parts), item, shipped, arrival], cents)
            own = nation.astype(np.int64) * parts + part
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(0, int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                lines = b"".join(x[a:b].tobytes() for x in (item, cents, shipped, arrival))
                out.append((int(nation[a]), int(part[a]), shipped[a:b].max(), lines))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["nation_id", "part", "latest", "lines"])

        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= block:
                yield told()
                held = 0
        if waiting:
            yield told()

    return rows.mapInArrow(pack, "nation_id int, part int, latest int, lines binary")


def _unpacked(lines: bytes) -> tuple[np.ndarray, ...]:
    n = len(lines) // 24
    wide, short = np.frombuffer(lines[: 16 * n], np.int64), np.frombuffer(lines[16 * n :], np.int32)
    return wide[:n], wide[n:], short[:n], short[n:]


def top(items: np.ndarray, revenue: np.ndarray, places: int = PLACES) -> list[tuple[int, int]]:
    """(item, revenue) of the highest positive revenues, ties to smaller items."""
    good = revenue > 0
    items, revenue = items[good], revenue[good]
    if len(items) > places:
        least = np.partition(revenue, len(revenue) - places)[len(revenue) - places]
        items, revenue = items[revenue >= least], revenue[revenue >= least]
    order = np.lexsort((items, -revenue))[:places]
    return list(zip(items[order].tolist(), revenue[order].tolist(), strict=True))


class Standing:
    """Revenues of a part's items, sorted by item, and its board."""

    def __init__(self, items: np.ndarray, revenue: np.ndarray):
        self.items, self.revenue = items, revenue
        self.board = top(items, revenue)

    def fold(self, items: np.ndarray, cents: np.ndarray) -> list[tuple[int, int, bool]]:
        """Add a day's distinct items, all of them known here; (item, revenue, shown) of the board if it changed and of what
        left it, else nothing.

        What was neither on the board nor touched ranks below the old last place.  Only if the new last place fell
        below that are all items looked at.
        """
        at = np.searchsorted(self.items, items)
        self.revenue[at] += cents
        old = self.board
        own = np.searchsorted(self.items, np.array([i for i, _ in old], np.int64))
        near = np.union1d(at, own)
        new = top(self.items[near], self.revenue[near])
        if len(old) == PLACES and (len(new) < PLACES or (-new[-1][1], new[-1][0]) > (-old[-1][1], old[-1][0])):
            new = top(self.items, self.revenue)
        self.board = new
        if new == old:
            return []
        on = {i for i, _ in new}
        left = [(i, int(self.revenue[np.searchsorted(self.items, i)]), False) for i, _ in old if i not in on]
        return [(i, r, True) for i, r in new] + left


def _part_of_nation(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffer the lines of a nation's part by arrival day; fold the days that the watermark has passed, in order.

    The timer is set to the earliest day that waits; it fires once the watermark has passed it.
    """
    raw = [x for frame in frames for x in frame["lines"]]
    if pd.isna(key[0]):
        return
    watermark = state.getCurrentWatermarkMs()
    waiting, known = state.get if state.exists else (b"", b"")
    n = len(waiting) // 20
    items, cents, days = [np.frombuffer(waiting[: 8 * n], np.int64)], [np.frombuffer(waiting[8 * n : 16 * n], np.int64)], [np.frombuffer(waiting[16 * n :], np.int32)]
    for item, cent, shipped, arrival in map(_unpacked, raw):
        good = shipped.astype(np.int64) * DAY_MS > watermark
        items.append(item[good])
        cents.append(cent[good])
        days.append(arrival[good])
    (day, item), cent = _summed([np.concatenate(days), np.concatenate(items)], np.concatenate(cents))
    due = int(np.searchsorted(day, watermark // DAY_MS, "right"))
    if due:
        m = len(known) // 16
        before, sums = np.frombuffer(known[: 8 * m], np.int64), np.frombuffer(known[8 * m :], np.int64)
        all_items = np.union1d(before, item[:due])
        revenue = np.zeros(len(all_items), np.int64)
        revenue[np.searchsorted(all_items, before)] = sums
        standing, out = Standing(all_items, revenue), []
        cuts = [0, *(np.flatnonzero(day[1:due] != day[: due - 1]) + 1).tolist(), due]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out += [(*key, int(day[a]), *row) for row in standing.fold(item[a:b], cent[a:b])]
        known = standing.items.tobytes() + standing.revenue.tobytes()
        yield pd.DataFrame(out, columns=["nation_id", "part", "arrival_day", "item_id", "revenue", "shown"])
    state.update((item[due:].tobytes() + cent[due:].tobytes() + day[due:].tobytes(), known))
    if due < len(day):
        state.setTimeoutTimestamp(int(day[due]) * DAY_MS)


def part_boards(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """BOARD rows of a stream of LINE rows: for each arrival day that changes the board of a part of a nation, that board,
    and what left it.

    Lines shipped more than LATE days before the latest that earlier batches have seen are dropped; days count from 1970.
    """
    seen = packed(rows, parts).withColumn("seen", F.timestamp_seconds(F.col("latest").cast("long") * 86_400))
    timed = seen.withWatermark("seen", f"{LATE} days 1 millisecond").select("nation_id", "part", "lines", "seen")
    grouped = timed.groupBy("nation_id", "part")
    return grouped.applyInPandasWithState(
        _part_of_nation, BOARD, "waiting binary, known binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def changes(boards: DataFrame) -> DataFrame:
    """The change feed of nations from the boards of their parts (BOARD).

    A nation's ten best are among the ten best of its parts, so what meets here is at most PLACES rows a part and day,
    whatever the number of lines.  A part's board holds from its day to the part's next.
    """
    dated = boards.select("nation_id", "part", "arrival_day").distinct()
    dated = dated.withColumn("until", F.lead("arrival_day").over(Window.partitionBy("nation_id", "part").orderBy("arrival_day")))
    moments = dated.groupBy("nation_id").agg(F.array_sort(F.collect_set("arrival_day")).alias("moments"))
    held_from = boards.join(dated, ["nation_id", "part", "arrival_day"]).join(moments, "nation_id")
    days = F.when(
        F.col("shown"), F.expr("filter(moments, d -> d >= arrival_day AND (until IS NULL OR d < until))")
    ).otherwise(F.array("arrival_day"))
    valid = held_from.withColumn("day", F.explode(days)).select("nation_id", "day", "item_id", "revenue", "shown", "moments")
    order = Window.partitionBy("nation_id", "day", "shown").orderBy(F.desc("revenue"), "item_id")
    ranked = valid.withColumn("rank", F.when(F.col("shown"), F.row_number().over(order)))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= PLACES, F.col("rank")))
    following = F.expr("try_element_at(moments, cast(array_position(moments, day) AS int) + 1)")
    none = F.lit(None)
    sides = F.explode(
        F.array(
            F.struct(F.col("day").alias("day"), F.col("revenue").alias("revenue"), F.col("rank").alias("new_rank"), none.cast("int").alias("old_rank")),
            F.struct(following.alias("day"), none.cast("long").alias("revenue"), none.cast("int").alias("new_rank"), F.col("rank").alias("old_rank")),
        )
    )
    met = ranked.select("nation_id", "item_id", sides.alias("s")).where("s.day IS NOT NULL AND (s.revenue IS NOT NULL OR s.old_rank IS NOT NULL)")
    told = met.groupBy("nation_id", F.col("s.day").alias("arrival_day"), "item_id").agg(
        *(F.max(f"s.{c}").alias(c) for c in ("old_rank", "new_rank", "revenue"))
    )
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return told.where("NOT old_rank <=> new_rank").select(
        "nation_id", "arrival_day", "item_id", batch_of(F.col("arrival_day")).alias("batch"), change.alias("change"), "old_rank", "new_rank", "revenue"
    )


def change_feed(sales: DataFrame, items: DataFrame, vendors: DataFrame, parts: int = PARTS) -> DataFrame:
    """Changes of each nation's board, as a stream sees them that is started anew for each of the BATCHES.

    Lines are written by batch, and a batch's folder is moved to the stream's folder before the query starts on it.  A
    sentinel of END_DAY in the last batch moves the watermark past every day, once that batch is done; another, in a start
    of its own, lets the timers fire.  Folders are new at every call, under
    the shared folder, and go with storage.release.

    A nation's state is split into parts by item, so that a nation with most lines is several groups; lines are summed
    up by item and days in the task that reads them, so a frequent item is a few rows a task.

    Defined results: lines without a known item or a vendor's nation count only for lateness; repeated lines add
    again; a null flag is none; an empty table gives an empty feed; only the named columns are read.
    """
    spark = sales.sparkSession
    home = scratch(spark, "leaderboard")
    staged, feed, out = f"{home}/staged", f"{home}/feed", f"{home}/boards"
    lines(sales, items, vendors).write.partitionBy("batch").parquet(staged)
    for k in (BATCHES, BATCHES + 1):
        spark.createDataFrame([(END_DAY, END_DAY, None, None, None)], LINE).coalesce(1).write.mode("append").parquet(f"{staged}/batch={k}")
    publish(spark, None, feed)
    stream = part_boards(spark.readStream.schema(f"{LINE}, batch int").parquet(feed).drop("batch"), parts)
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.minBatchesToRetain": "2"}
    with held(spark, settings):
        for k in range(1, BATCHES + 2):
            publish(spark, f"{staged}/batch={k}", f"{feed}/batch={k}")
            query = (
                stream.writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", f"{home}/checkpoint")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    return changes(spark.read.schema(BOARD).parquet(out))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all sale lines."""
    return change_feed(*(table(spark, sf_dir, name) for name in ("sale_lines", "items", "vendors")))


_KEY = "concat_ws(',', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("sale_id", "item_id", "vendor_id", "line_no")) + ")"
OP13_SQL = f"""
WITH {CRC_TABLE},
hashed AS (SELECT s.*, {crc32_sql(_KEY)} AS h FROM sale_lines s, crc_table),
shipped AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), 19723 + h % 150) AS s FROM hashed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM shipped),
dealt AS (SELECT *, CAST(greatest(1, least(8, 1 + floor((a - 19723) * 8 / 180))) AS INTEGER) AS batch FROM arrived),
latest AS (SELECT batch, max(s) AS s FROM dealt GROUP BY batch),
before AS (SELECT x.batch, max(y.s) AS seen FROM latest x LEFT JOIN latest y ON y.batch < x.batch GROUP BY x.batch),
prices AS (SELECT item_id, min(price) AS price FROM items GROUP BY item_id),
homes AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id),
counted AS (
  SELECT nation_id, item_id, a, CAST(sum(CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END *
           CAST(coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) AS BIGINT)) AS BIGINT) AS cents
  FROM dealt JOIN before USING (batch) JOIN prices USING (item_id) JOIN homes USING (vendor_id)
  WHERE nation_id IS NOT NULL AND (seen IS NULL OR s + 15 >= seen) GROUP BY ALL
),
running AS (SELECT nation_id, item_id, a, CAST(sum(cents) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS BIGINT) AS revenue FROM counted),
days AS (SELECT *, lag(a) OVER (PARTITION BY nation_id ORDER BY a) AS previous FROM (SELECT DISTINCT nation_id, a FROM counted)),
places AS (SELECT d.nation_id, d.a, d.previous, i.item_id FROM days d JOIN (SELECT DISTINCT nation_id, item_id FROM counted) i USING (nation_id)),
standing AS (
  SELECT p.*, r.revenue FROM places p ASOF JOIN running r ON p.nation_id = r.nation_id AND p.item_id = r.item_id AND p.a >= r.a
),
ranked AS (
  SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, a, revenue > 0 ORDER BY revenue DESC, item_id) END AS place
  FROM standing
),
board AS (SELECT nation_id, a, previous, item_id, revenue, CASE WHEN place <= 10 THEN CAST(place AS INTEGER) END AS place FROM ranked)
SELECT n.nation_id, CAST(n.a AS BIGINT) AS arrival_day, n.item_id,
       CAST(greatest(1, least(8, 1 + floor((n.a - 19723) * 8 / 180))) AS INTEGER) AS batch,
       CASE WHEN o.place IS NULL THEN 'enter' WHEN n.place IS NULL THEN 'exit' ELSE 'move' END AS change,
       o.place AS old_rank, n.place AS new_rank, n.revenue
FROM board n LEFT JOIN board o ON o.nation_id = n.nation_id AND o.item_id = n.item_id AND o.a = n.previous
WHERE n.place IS DISTINCT FROM o.place
"""
