"""Greedy packing of pages into size-bounded chunks.

The rule is sequential: walk the pages of a document in order and start a new
chunk when the buffer is not empty and buffer + page would pass the budget.
The separator counts once it is in the buffer, but not in the test.

A document can be far too long for one task, so it is cut into blocks of
``2**BLOCK_BITS`` page numbers.  What a block does to the buffer length that
enters it is a step function with few steps:

    entering length > cap_i  ->  leaves with buf_i, after n_i new chunks
    at or below every cap    ->  leaves with entering length + total, no new chunk

Step functions compose, so the blocks are folded up a fixed tree, the entering
length of every block comes back down, and each block then packs its own pages.
The tree is a job of its own over page sizes and leaves a small stored table.
Page texts are shuffled once, by (document, block); chunks that cross a block
edge are the only pieces joined up afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import stage

BLOCK_BITS = 6
FAN_IN_BITS = 12
PAGE_BITS = 42
SEPARATOR = "\n\n"

# "Longer than any budget": the first page of a document always opens a chunk.
_FULL = 1 << 60
_STEP = "struct<cap:bigint,buf:bigint,n:bigint>"
_ENTRY = "struct<buf:bigint,n:bigint>"


def _long(x) -> Column:
    return F.lit(x).cast("bigint")


def _parent(at: str, bits: int) -> Column:
    # coalesce() makes the key visibly non-null: joins then add no null filter of
    # their own, which would make otherwise equal subplans differ.
    return F.coalesce(F.shiftright(at, bits), _long(0))


def _entry(buf: Column, n: Column) -> Column:
    return F.struct(buf.alias("buf"), n.alias("n"))


def _step(cap: Column, buf: Column, n: Column) -> Column:
    return F.struct(cap.alias("cap"), buf.alias("buf"), n.alias("n"))


def _advance(state: Column, size: Column, budget: int, gap: int) -> Column:
    """Buffer length and chunk count after one more page."""
    return F.when(state["buf"] + size > budget, _entry(size, state["n"] + 1)).otherwise(
        _entry(state["buf"] + gap + size, state["n"])
    )


def _through(total: Column, steps: Column, buf: Column, n: Column) -> Column:
    """Send an entering buffer length through a step function."""
    hit = F.get(F.filter(steps, lambda s: buf > s["cap"]), F.lit(0))
    return F.when(hit.isNull(), _entry(buf + total, n)).otherwise(_entry(hit["buf"], n + hit["n"]))


def _block_function(sizes: Column, budget: int, gap: int) -> Column:
    """Step function of one block, from its page sizes.

    A page can only be the first to open a chunk if it tolerates less than
    every page before it, so the caps are the record minima.
    """
    record = "struct<cap:bigint,at:int>"
    start = F.struct(
        _long(0).alias("total"), F.lit(1).alias("at"), _long(_FULL).alias("low"),
        F.array().cast(f"array<{record}>").alias("records"),
    )

    def scan(s: Column, size: Column) -> Column:
        cap = _long(budget) - s["total"] - size
        is_record = (cap < s["low"]) & (s["low"] > 0)
        grown = F.array_append(s["records"], F.struct(cap.alias("cap"), s["at"].alias("at")))
        return F.struct(
            (s["total"] + size + gap).alias("total"), (s["at"] + 1).alias("at"),
            F.least(s["low"], cap).alias("low"),
            F.when(is_record, grown).otherwise(s["records"]).alias("records"),
        )

    def step(r: Column) -> Column:
        rest = F.slice(sizes, r["at"], F.size(sizes))
        end = F.aggregate(rest, _entry(_long(_FULL), _long(0)), lambda s, z: _advance(s, z, budget, gap))
        return _step(r["cap"], end["buf"], end["n"])

    return F.aggregate(
        sizes, start, scan,
        lambda s: F.struct(s["total"].alias("total"), F.transform(s["records"], step).alias("steps")),
    )


def _then(f: Column, g: Column) -> Column:
    """The step function that runs ``f`` and then ``g``."""

    def after(s: Column) -> Column:
        end = _through(g["total"], g["steps"], s["buf"], s["n"])
        return _step(s["cap"], end["buf"], end["n"])

    low = F.when(F.size(f["steps"]) > 0, F.element_at(f["steps"], -1)["cap"]).otherwise(_long(_FULL))
    moved = F.transform(g["steps"], lambda s: _step(s["cap"] - f["total"], s["buf"], s["n"]))

    def reachable(s: Column, i: Column) -> Column:
        before = F.when(i == 0, low).otherwise(F.get(g["steps"], i - 1)["cap"] - f["total"])
        return (s["cap"] < low) & (low > 0) & (before > 0)

    return F.struct(
        (f["total"] + g["total"]).alias("total"),
        F.concat(F.transform(f["steps"], after), F.filter(moved, reachable)).alias("steps"),
    )


def _fold(children: Column) -> Column:
    empty = F.struct(_long(0).alias("total"), F.array().cast(f"array<{_STEP}>").alias("steps"))
    return F.aggregate(children, empty, _then)


def _hand_down(children: Column, entry: Column, next_cap: Column) -> Column:
    """What enters every child, and the cap its right neighbour opens with."""
    state = F.struct(
        entry["buf"].alias("buf"), entry["n"].alias("n"),
        F.array().cast(f"array<{_ENTRY}>").alias("out"),
    )

    def scan(s: Column, c: Column) -> Column:
        end = _through(c["total"], c["steps"], s["buf"], s["n"])
        seen = F.array_append(s["out"], _entry(s["buf"], s["n"]))
        return F.struct(end["buf"].alias("buf"), end["n"].alias("n"), seen.alias("out"))

    def child(c: Column, i: Column, entries: Column) -> Column:
        e = F.get(entries, i)
        right = F.get(F.get(children, i + 1)["steps"], F.lit(0))["cap"]
        return F.struct(
            c["at"].alias("at"), e["buf"].alias("buf"), e["n"].alias("n"),
            F.coalesce(right, next_cap).alias("next_cap"),
        )

    entered = F.aggregate(children, state, scan, lambda s: s["out"])
    return bind(entered, lambda entries: F.transform(children, lambda c, i: child(c, i, entries)))


def _gather(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Collect the functions of at most 2**FAN_IN_BITS neighbouring nodes, in order."""
    node = F.struct(F.col(at).alias("at"), F.col("total"), F.col("steps"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("children"))


def _levels(page_bits: int) -> int:
    """Tree levels between the blocks and the document, so that no node is wide."""
    return max(1, -(-(page_bits - BLOCK_BITS) // FAN_IN_BITS) - 1)


def _in_order(pages: DataFrame, column: str) -> DataFrame:
    """(doc_id, block, pages): one column of each block's pages, in page order."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", column)))
    return pages.groupBy("doc_id", "block").agg(rows.alias("pages"))


def _block_entries(blocks: DataFrame, budget: int, gap: int, levels: int) -> DataFrame:
    """(doc_id, block, buf, n, next_cap): the state in which every block starts."""
    sizes = F.transform("pages", lambda p: p["size"])
    function = bind(sizes, lambda z: _block_function(z, budget, gap))
    nodes = blocks.select("doc_id", F.col("block").alias("b0"), function.alias("f"))
    nodes = nodes.select("doc_id", "b0", "f.total", "f.steps")
    groups = []
    for level in range(1, levels + 1):
        below, here = f"b{level - 1}", f"b{level}"
        up = nodes.withColumn(here, _parent(below, FAN_IN_BITS))
        grouped = _gather(up, ["doc_id", here], below)
        groups.append(grouped)
        nodes = grouped.select("doc_id", here, _fold(F.col("children")).alias("f"))
        nodes = nodes.select("doc_id", here, "f.total", "f.steps")
    top = _gather(nodes, ["doc_id"], f"b{levels}")
    fresh = _entry(_long(_FULL), _long(0))
    state = top.select("doc_id", F.inline(_hand_down(F.col("children"), fresh, _long(-1))))
    for level in range(levels, 0, -1):
        grouped = groups[level - 1]
        joined = grouped.join(state.withColumnRenamed("at", f"b{level}"), ["doc_id", f"b{level}"])
        down = _hand_down(F.col("children"), F.struct("buf", "n"), F.col("next_cap"))
        state = joined.select("doc_id", F.inline(down))
    return state.withColumnRenamed("at", "block")


def _pack_block(pages: Column, buf: Column, n: Column, next_cap: Column, budget: int, gap: int) -> Column:
    """The pieces of chunks inside one block."""
    state = F.struct(
        buf.alias("buf"), n.alias("n"), F.lit(1).alias("at"),
        F.array().cast("array<int>").alias("opens"),
    )

    def scan(s: Column, p: Column) -> Column:
        size = F.length(p["text"]).cast("bigint")
        opens = s["buf"] + size > budget
        return F.struct(
            F.when(opens, size).otherwise(s["buf"] + gap + size).alias("buf"),
            F.when(opens, s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["at"] + 1).alias("at"),
            F.when(opens, F.array_append(s["opens"], s["at"])).otherwise(s["opens"]).alias("opens"),
        )

    def pieces(s: Column) -> Column:
        carried = F.coalesce(F.get(s["opens"], F.lit(0)) != 1, F.lit(True))
        bounds = F.when(carried, F.array_prepend(s["opens"], F.lit(1))).otherwise(s["opens"])
        return bind(bounds, lambda b: cut(s, carried, b))

    def cut(s: Column, carried: Column, bounds: Column) -> Column:
        first = F.when(carried, n - 1).otherwise(n)
        runs_on = s["buf"] <= next_cap

        def piece(at: Column, i: Column) -> Column:
            last = i == F.size(bounds) - 1
            stop = F.coalesce(F.get(bounds, i + 1), F.size(pages) + 1)
            texts = F.transform(F.slice(pages, at, stop - at), lambda p: p["text"])
            return F.struct(
                (first + i).alias("index"),
                F.array_join(texts, SEPARATOR).alias("original"),
                (~(((i == 0) & carried) | (last & runs_on))).alias("whole"),
            )

        return F.transform(bounds, piece)

    return F.aggregate(pages, state, scan, pieces)


def rejected_pages(pages: DataFrame) -> DataFrame:
    """The rows that ``chunk_pages`` can place nowhere, all their columns and ``reason``: no doc_id, or no page_no."""
    reason = F.when(F.col("doc_id").isNull(), "no doc_id").when(F.col("page_no").isNull(), "no page_no")
    return pages.withColumn("reason", reason).filter("reason IS NOT NULL")


def chunk_pages(pages: DataFrame, max_chars: int, page_bits: int = PAGE_BITS) -> DataFrame:
    """(doc_id, page_no, text) -> (doc_id, index, original).

    ``page_no`` orders the pages of a document, is unique in it and may have
    gaps.  With numbers below 2**page_bits no node of the tree has more than
    2**FAN_IN_BITS children; larger numbers are packed right too, just slower.

    Page sizes are read first and texts afterwards, so texts that are dear to
    compute should come from a stored table.  If that has a ``size`` column with
    the length of each text, the first pass reads no texts at all, but those of
    rows whose size is null.  Pages without text are passed over; rows without a
    doc_id or page_no belong to no chunk and come out of ``rejected_pages``.
    """
    gap = len(SEPARATOR)
    stored = "size" in pages.columns
    # Stated null checks keep the two readers of the texts below identical, so that
    # Spark sees one and the same exchange and runs it once.
    used = pages.filter("doc_id is not null and page_no is not null").filter("coalesce(size, length(text)) > 0" if stored else "text != ''")
    used = used.withColumn("block", _parent("page_no", BLOCK_BITS))

    measured = used.select("doc_id", "block", "page_no", F.length("text").cast("bigint").alias("size"))
    if stored:
        # Two scans: the one of sizes reads no texts, and the other none but where files hold null sizes.
        slim = pages.filter("doc_id is not null and page_no is not null").withColumn("block", _parent("page_no", BLOCK_BITS))
        missing = slim.filter("size IS NULL AND text != ''").select("doc_id", "block", "page_no", F.length("text").cast("bigint").alias("size"))
        measured = slim.filter("size > 0").select("doc_id", "block", "page_no", F.col("size").cast("bigint").alias("size")).unionByName(missing)
    entries = stage(
        _block_entries(_in_order(measured, "size"), max_chars, gap, _levels(page_bits)),
        "packing")
    blocks = _in_order(used, "text")
    packed = _pack_block(F.col("pages"), F.col("buf"), F.col("n"), F.col("next_cap"), max_chars, gap)
    parts = blocks.join(entries, ["doc_id", "block"]).select("doc_id", "block", F.inline(packed))
    whole = parts.filter("whole").select("doc_id", "index", "original")
    # Pieces of one chunk: together within the budget, so the group is small.
    crossing = (
        parts.filter(~F.col("whole"))
        .groupBy("doc_id", "index")
        .agg(F.array_sort(F.collect_list(F.struct("block", "original"))).alias("p"))
        .select("doc_id", "index",
                F.array_join(F.transform("p", lambda x: x["original"]), SEPARATOR).alias("original"))
    )
    return whole.unionByName(crossing)
