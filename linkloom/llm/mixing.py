"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. A source's budget is whole passes over it plus a
rest; the rest becomes a hash threshold: the cumulative histogram names the bucket in which the
budget ends, only that bucket is refined by the next hash bits, until it holds one hash. Rows
below the threshold are taken once more. Rows that share the one hash at the boundary are copies;
the same refinement over their places splits them. What the budget still lacks is filled by
further thresholds over the smaller rows above it. No row is sorted, and reruns agree because the
hash depends on the row's id and text alone.

Rows: null text has size 0; a null source is a source of its own, last in order; rows that agree
in id and text, null ids too, are copies of which as many are taken as the budget says. A source
without words gets target 0. An empty table gives an empty result; other columns are kept by
mixed_documents, whatever their names, and ignored by mix. Long texts are counted whole.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target is at most so many times its size.
MAX_REPEATS = 3
#: Hash bits of a histogram round; at most 2**ROUND_BITS rows per source reach the driver.
ROUND_BITS = 10
#: Bits of a hash, and of a row's place.
HASH_BITS = 62
#: Further thresholds over rows of at most a quarter of what the budget still lacks.
FILLS = 2
#: With more sources than this the plan is joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
PLAN = "src string, source_size long, target double, whole int, below array<long>, most array<long>, tie long, tie_left double, tie_below long"


def water_fill(sizes: dict, total: float, weights=WEIGHTS, most: float = MAX_REPEATS) -> dict:
    """Targets by weight, at most ``most`` times a size; what exceeds is shared anew by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    full: dict = {}
    while True:
        open_ = [s for s in order if s not in full]
        left, shares = total - sum(full.values()), sum(weight[s] for s in open_)
        target = {s: left * weight[s] / shares for s in open_} if shares else {}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return {s: float(full.get(s, target.get(s, 0.0))) for s in order}
        full |= {s: float(most * sizes[s]) for s in over}


def _with(rows: DataFrame, by_source: DataFrame, n: int, more: Column | None = None) -> DataFrame:
    """rows joined with one row per source, which is broadcast only if its number n is small."""
    same = rows["source"].eqNullSafe(by_source["src"])
    return rows.join(F.broadcast(by_source) if n <= BROADCAST_SOURCES else by_source, same if more is None else same & more)


def _thresholds(rows: DataFrame, budgets: dict, bits: int, by: str = "hash") -> dict:
    """Per source (limit, left, shared): rows whose ``by`` is below limit sum to the budget at most, left of
    it remains; shared if several rows have the limit itself, which then no threshold can split."""
    found = {s: (0, 0.0, False) for s, b in budgets.items() if b <= 0}
    state = {s: (0, 0, float(b)) for s, b in budgets.items() if b > 0}  # prefix, its bits, what is left to take
    spark = rows.sparkSession
    while state:
        depth = next(iter(state.values()))[1]
        step = min(bits, HASH_BITS - depth)
        at = spark.createDataFrame([(s, p) for s, (p, _, _) in state.items()], "src string, prefix long")
        near = _with(rows, at, len(state), F.shiftright(by, HASH_BITS - depth) == F.col("prefix"))
        cells: dict = {}
        sums = near.groupBy("source", F.shiftright(by, HASH_BITS - depth - step).alias("cell")).agg(F.sum("size"), F.count("*"), F.min(by), F.max(by))
        for s, *cell in sums.collect():
            cells.setdefault(s, []).append(cell)
        after = {}
        for s, (prefix, _, left) in state.items():
            own = sorted(cells.get(s, []))
            total = list(accumulate(x[1] for x in own))
            k = bisect_right(total, left)
            if k == len(own):
                found[s] = ((prefix + 1) << (HASH_BITS - depth), left - (total[-1] if total else 0), False)
                continue
            cell, _, n, low, high = own[k]
            left -= total[k - 1] if k else 0
            if low == high:
                found[s] = (low, left, n > 1)
            else:
                after[s] = (cell, depth + step, left)
        state = after
    return found


def _split(ties: DataFrame, lefts: dict, bits: int) -> dict:
    """Per source (place limit, left): how far its copies at the boundary are taken. ties: (source, size, place)."""
    return {s: x[:2] for s, x in _thresholds(ties, lefts, bits, "place").items()}


def _hash(id_: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_, text), 64 - HASH_BITS)


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def once_more(size: Column, hash_: Column, tie_taken: Column) -> Column:
    """Whether a row is taken once more: below one of its source's thresholds, or a copy at the boundary that is."""
    below = F.exists(F.arrays_zip("below", "most"), lambda x: (hash_ < x["below"]) & (size <= x["most"]))
    return below | F.coalesce((hash_ == F.col("tie")) & tie_taken, F.lit(False))


def planned(rows: DataFrame, weights=WEIGHTS, most: float = MAX_REPEATS, total: float | None = None, bits: int = ROUND_BITS) -> tuple[list[tuple], int]:
    """The plan, a row per source in PLAN's columns, and the bits of a round. rows: (source, size, hash, place)."""
    spark = rows.sparkSession
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}  # a row per source
    targets = water_fill(sizes, sum(sizes.values()) if total is None else total, weights, most)
    whole = {s: min(int(most), int(targets[s] // n)) if n else 0 for s, n in sizes.items()}
    while bits > 1 and len(sizes) << bits > 1 << 20:
        bits -= 1
    budgets = {s: targets[s] - whole[s] * n for s, n in sizes.items()}
    levels, ties, small = [], {}, rows
    # thresholds over all rows, then over ever smaller rows above them, for what the budget still lacks
    for turn in range(1 + FILLS):
        found = _thresholds(small, budgets, bits)
        lacks = {s: x[1] for s, x in found.items()}
        levels.append({s: (found[s][0] if s in found else 0, 1 << HASH_BITS if not turn else int(budgets[s] // 4)) for s in sizes})
        if not turn and (shared := {s: x for s, x in found.items() if x[2]}):
            at = spark.createDataFrame([(s, x[0]) for s, x in shared.items()], "src string, tie long")
            copies = _with(rows, at, len(shared), F.col("hash") == F.col("tie")).select(*rows.columns)
            split = _split(copies, {s: x[1] for s, x in shared.items()}, bits)
            ties = {s: (shared[s][0], float(shared[s][1]), split[s][0]) for s in shared}
            lacks |= {s: x[1] for s, x in split.items()}
        if turn == FILLS or not any(x >= 4 for x in lacks.values()):
            break
        budgets = {s: lacks.get(s, 0.0) for s in sizes}
        step = spark.createDataFrame([(s, levels[-1][s][0], int(budgets[s] // 4), *(ties.get(s, (None, None, None))[::2] if not turn else (None, None))) for s in sizes], "src string, low long, upto long, own_tie long, own_below long")
        taken = F.coalesce((F.col("hash") == F.col("own_tie")) & (F.col("place") < F.col("own_below")), F.lit(False))
        small = _with(small, step, len(sizes), (F.col("hash") >= F.col("low")) & (F.col("size") <= F.col("upto")) & ~taken).select(*rows.columns)
    return [(s, n, targets[s], whole[s], [x[s][0] for x in levels], [x[s][1] for x in levels], *ties.get(s, (None, None, None))) for s, n in sizes.items()], bits


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), _size(text).alias("size"), _hash(docs[id_col], text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    return materialise(rows, "mix-sizes")  # written once, so a row's place stays what it is


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    One row per source reaches the driver, with 2**bits sums each; rows never do. kw: weights, most,
    total (the budget in words, by default the size of all sources together) and bits.
    """
    rows = _rows(docs, id_col, text_col, source_col)
    plan, _ = planned(rows, **kw)
    joined = _with(rows, docs.sparkSession.createDataFrame(plan, PLAN), len(plan))
    times = F.col("whole") + once_more(F.col("size"), F.col("hash"), F.col("place") < F.col("tie_below")).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of docs."""
    spark = docs.sparkSession
    plan, bits = planned(_rows(docs, id_col, text_col, source_col), **kw)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].cast("string").alias("source"), _size(text).alias("size"), _hash(docs[id_col], text).alias("hash"))
    rows = _with(rows, spark.createDataFrame(plan, PLAN), len(plan))
    again = lambda taken: F.explode(F.array_repeat(F.lit(0), F.col("whole") + once_more(F.col("size"), F.col("hash"), taken).cast("int")))
    ties = {p[0]: p[7] for p in plan if p[6] is not None}
    is_tie = F.coalesce(F.col("hash") == F.col("tie"), F.lit(False))
    out = rows.where(~is_tie).select("row", again(F.lit(False)).alias("copy"))
    if ties:  # the copies at a boundary, written once with their places
        copies = materialise(rows.where(is_tie).withColumn("place", F.monotonically_increasing_id()).drop("tie_below", "src"), "mix-copies")
        split = spark.createDataFrame([(s, x[0]) for s, x in _split(copies, ties, bits).items()], "src string, tie_below long")
        out = out.unionByName(_with(copies, split, len(ties)).select("row", again(F.col("place") < F.col("tie_below")).alias("copy")))
    return out.select("row.*")
