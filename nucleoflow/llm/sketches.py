"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nucleoflow.functions.ordering import numbered
from nucleoflow.functions.vectors import let
from nucleoflow.llm.common import null_back, partitions, small, texts
from nucleoflow.session import materialize

#: A paragraph ends at a line break, or after a sentence whose last letter is one of a to m.
PARAGRAPH = r"\n+|(?<=[a-m][.!?])\s+"
#: A fingerprint has three tables of so many cells.
BASE = 5
CHECK = 77
#: Documents that share one sorted window, about.
RUN_DOCS = 2000
BORDERS = 2000
ROUNDS = 12


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs, empty ones left out."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda x: x != ""), lambda x: F.xxhash64(x)))


def cell(key: Column, table: int | Column, width: Column) -> Column:
    """Place of a digest in one of the three tables, which lie one after the other."""
    at = F.lit(table).cast("long") if isinstance(table, int) else table
    return at * width + F.pmod(F.xxhash64(key, at), width)


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK))


def fingerprint(digests: Column) -> Column:
    """Cells of a set as text: count, exclusive or of the digests, and of their checks."""
    fold = lambda ks: F.aggregate(ks, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(k))
    width = F.lit(BASE).cast("long")

    def shown(mine: Column) -> Column:
        sums = F.concat(F.lpad(F.hex(fold(mine)), 16, "0"), F.lpad(F.hex(fold(F.transform(mine, check))), 16, "0"))
        return F.concat(F.lpad(F.hex(F.size(mine)), 4, "0"), sums)

    def one(place: Column) -> Column:
        at = F.floor(place / BASE).cast("long")
        return let(F.filter(digests, lambda k: cell(k, at, width) == place), shown)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 * BASE - 1)), one), "")


def decoded(cells: DataFrame, *keys: str, rounds: int = ROUNDS, digests: bool = False) -> DataFrame:
    """(keys, found, open) from cells (keys, width, cell, n, key, check) of subtracted sketches.

    Rows with a negative cell are handed on. Table after table, cells that hold
    a single digest are peeled: the digest leaves its cells in the two other
    tables. A digest has one cell in each table, so no digest is peeled twice.
    ``keys`` must hold the columns that the rows are partitioned by; then no
    round shuffles. With ``digests`` the peeled digests are returned, else their count.
    """
    group = [*keys, "width", "cell"]
    for step in range(rounds):
        t = step % 3
        pure = (
            (F.col("cell") >= t * F.col("width"))
            & (F.col("cell") < (t + 1) * F.col("width"))
            & (F.abs("n") == 1)
            & (F.col("check") == check(F.col("key")))
            & (F.col("cell") == cell(F.col("key"), t, F.col("width")))
        )
        rest = lambda place: F.struct(place.alias("cell"), (-F.col("n")).alias("n"), F.col("key"), F.col("check"))
        zero = F.lit(0).cast("long")
        taken = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(1).cast("long").alias("n"), zero.alias("key"), zero.alias("check"))
        if digests:
            taken = F.struct((-F.col("key").bitwiseAND(F.lit(2**62 - 1)) - 1).alias("cell"), F.col("n"), F.col("key"), F.col("check"))
        peeled = F.array(*[rest(cell(F.col("key"), u, F.col("width"))) for u in range(3) if u != t], taken)
        same = F.array(F.struct("cell", "n", "key", "check"))
        moved = cells.select(*keys, "width", F.explode(F.when(pure, peeled).otherwise(same)).alias("c")).select(*keys, "width", "c.*")
        cells = _summed(moved, group)
    return cells


def _summed(rows: DataFrame, group: list[str]) -> DataFrame:
    sums = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return sums.where("cell < 0 or n <> 0 or key <> 0 or check <> 0")


def in_three_tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cell entries (width, cell, n, key, check) of rows with a digest ``key``, a sign ``n`` and a ``width``; width null hands the row on."""
    tables = F.when(F.col("width").isNull(), F.lit([0])).otherwise(F.lit([0, 1, 2]))
    rows = rows.select(*keys, "width", "n", "key", F.explode(tables).alias("t")).withColumn("t", F.col("t").cast("long"))
    at = F.when(F.col("width").isNull(), F.lit(-2).cast("long")).otherwise(cell(F.col("key"), F.col("t"), F.col("width")))
    checked = F.when(F.col("width").isNull(), F.lit(0).cast("long")).otherwise(check(F.col("key")))
    return rows.select(*keys, F.coalesce("width", F.lit(0).cast("long")).alias("width"), at.alias("cell"), "n", "key", checked.alias("check"))


def next_pairs(docs: DataFrame) -> DataFrame:
    """(run, place, doc_id, text, next_id, next_text): each row with the row after it; after the last comes the first.

    Runs are ranges of doc_id, cut at sampled quantiles and evenly between
    them. Each run also gets the first document of the next one, so a window
    over a run sees every successor, and texts are shuffled once.
    """
    rows = texts(docs)
    count, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cuts = max(1, min(BORDERS, count // RUN_DOCS))
    at = [k / cuts for k in range(1, cuts)]
    found = rows.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] if at and count else []
    borders = sorted({low or 0, *(found or []), (high or 0) + 1})
    parts = max(1, -(-count // (RUN_DOCS * max(1, len(borders) - 1))))
    edge = F.lit(borders)
    # the last border that isn't above the id, by halving
    jumps = F.lit([1 << k for k in reversed(range(len(borders).bit_length()))])

    def halve(lo: Column, jump: Column) -> Column:
        fits = (lo + jump <= len(borders)) & (F.get(edge, F.least(lo + jump, F.lit(len(borders))) - 1) <= F.col("doc_id"))
        return F.when(fits, lo + jump).otherwise(lo)

    slot = F.aggregate(jumps, F.lit(0), halve) - 1
    if parts > 1:
        begin, end = F.get(edge, slot), F.get(edge, slot + 1)
        real = lambda c: c.cast("double")
        within = F.floor((real(F.col("doc_id")) - real(begin)) * parts / (real(end) - real(begin)))
        run = slot.cast("long") * parts + F.least(within.cast("long"), F.lit(parts - 1).cast("long"))
    else:
        run = slot.cast("long")
    rows = rows.withColumn("run", run)
    firsts = numbered(rows.groupBy("run").agg(F.min("doc_id").alias("first")), F.col("run"))
    firsts = materialize(firsts)
    runs = firsts.count()
    before = firsts.select(F.pmod(F.col("index") + (runs - 1), F.lit(max(1, runs))).alias("before"), F.col("first"))
    guest = small(materialize(before.join(firsts.select(F.col("index").alias("before"), F.col("run").alias("to")), "before").select("first", "to")))
    own = rows.withColumn("guest", F.lit(False))
    guests = own.join(guest, F.col("doc_id") == F.col("first")).select("doc_id", "text", F.col("to").alias("run"), F.lit(True).alias("guest"))
    both = own.union(guests.select(*own.columns)).repartition(4 * partitions(docs.sparkSession), "run")
    order = Window.partitionBy("run").orderBy("guest", "doc_id", "text")
    return both.select(
        "run",
        F.row_number().over(order).alias("place"),
        "guest",
        "doc_id",
        "text",
        F.lead("doc_id").over(order).alias("next_id"),
        F.lead("text").over(order).alias("next_text"),
    ).where("not guest").drop("guest")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The likeness of two sets of n and m paragraphs of which d differ is
    (n + m - d) / (n + m + d), the shared part of their union; two empty sets
    are alike. d is what peeling recovers from the subtracted sketches; where
    cells are left over, larger ones are made until none is. Null texts count
    as empty. Rows that share a doc_id follow each other by text. A single row
    is its own successor. An empty table gives no rows.
    """
    done = materialize(_likeness(next_pairs(docs), 1))
    factor = 1
    failed = done.where("open > 0")
    while not failed.isEmpty():
        # few texts are needed again: those of the failed pairs, found by id and hash
        factor *= 4
        ends = [failed.select(F.col(i).alias("doc_id"), F.col(h).alias("name")) for i, h in (("doc_id", "name"), ("next_id", "next_name"))]
        wanted = small(materialize(ends[0].union(ends[1]).distinct()))
        held = texts(docs).withColumn("name", F.xxhash64("text")).join(wanted, ["doc_id", "name"]).dropDuplicates(["doc_id", "name"])
        held = materialize(held)
        after = held.select(F.col("doc_id").alias("next_id"), F.col("name").alias("next_name"), F.col("text").alias("next_text"))
        pairs = failed.select("run", "place", "doc_id", "name", "next_id", "next_name").join(held, ["doc_id", "name"]).join(after, ["next_id", "next_name"])
        retried = _likeness(pairs.repartition("run", "place"), factor)
        done = materialize(done.where("open = 0").union(retried))
        failed = done.where("open > 0")
    near = lambda n, m, d: F.when(F.col(n) + F.col(m) == 0, 1.0).otherwise(
        (F.col(n) + F.col(m) - F.col(d)) / (F.col(n) + F.col(m) + F.col(d))
    )
    return done.select(
        null_back("doc_id").alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        F.col("fa").alias("fingerprint"),
        F.col("fe").alias("edited_fingerprint"),
        near("na", "ne", "d2").alias("near_edited"),
        near("na", "nb", "d3").alias("near_next"),
    )


def _likeness(pairs: DataFrame, factor: int) -> DataFrame:
    """Recovered differences to the edited text (d2) and the next one (d3), and cells left open.

    ``pairs`` come partitioned by run, so that nothing more is shuffled.
    """
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = pairs.select("run", "place", "doc_id", "next_id", "text", "next_text", edited.alias("edited"))
    sized = rows.select(
        "run",
        "place",
        "doc_id",
        F.xxhash64("text").alias("name"),
        "next_id",
        F.xxhash64("next_text").alias("next_name"),
        F.length("text").alias("n_chars"),
        F.sha2("edited", 256).alias("sha"),
        paragraphs(F.col("text")).alias("a"),
        paragraphs(F.col("edited")).alias("e"),
        paragraphs(F.col("next_text")).alias("b"),
    )
    longs = ("doc_id", "name", "next_id", "next_name", "n_chars", "na", "ne", "nb")
    strings = ("sha", "fa", "fe")
    sized = sized.select("*", F.size("a").alias("na"), F.size("e").alias("ne"), F.size("b").alias("nb"))
    sized = sized.select("*", fingerprint(F.col("a")).alias("fa"), fingerprint(F.col("e")).alias("fe"))
    info = F.concat_ws("|", *longs, *strings)
    # only cells that hold something are rows, so wide tables cost little and fail rarely
    width2 = (F.ceil(F.greatest("na", "ne") * 0.75 * factor) + 48 * factor).cast("long")
    width3 = (F.ceil((F.col("na") + F.col("nb")) * 0.75 * factor) + 48 * factor).cast("long")
    # one row for the document, then a and e to be subtracted, then a and b
    digests = F.concat(F.array(F.lit(0).cast("long")), "a", "e", "a", "b")
    flat = sized.select("run", "place", info.alias("info"), "na", "ne", width2.alias("w2"), width3.alias("w3"), F.posexplode(digests).alias("pos", "key"))
    second = F.col("na") + F.col("ne")
    plus = (F.col("pos") <= F.col("na")) | ((F.col("pos") > second) & (F.col("pos") <= second + F.col("na")))
    first = F.col("pos") == 0
    flat = flat.select(
        "run",
        "place",
        F.when(first, 0).when(F.col("pos") <= second, 2).otherwise(3).alias("which"),
        F.when(first, F.col("info")).alias("info"),
        F.when(first, None).when(F.col("pos") <= second, F.col("w2")).otherwise(F.col("w3")).alias("width"),
        F.when(first, 0).when(plus, 1).otherwise(-1).cast("long").alias("n"),
        "key",
    )
    keys = ["run", "place", "which", "info"]
    left = decoded(_summed(in_three_tables(flat, keys), [*keys, "width", "cell"]), *keys)
    of = lambda w: F.coalesce(F.sum(F.when((F.col("which") == w) & (F.col("cell") == -1), F.col("n"))), F.lit(0))
    out = left.groupBy("run", "place").agg(
        F.max("info").alias("info"), of(2).alias("d2"), of(3).alias("d3"), F.count(F.when(F.col("cell") >= 0, 1)).alias("open")
    )
    part = F.split("info", r"\|")
    columns = [part.getItem(i).cast("long").alias(n) for i, n in enumerate(longs)]
    columns += [part.getItem(len(longs) + i).alias(n) for i, n in enumerate(strings)]
    return out.select("run", "place", *columns, "d2", "d3", "open")


def differing(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, digest, n) of the paragraphs that differ between the texts ``a`` and ``b`` of each id: n is 1 in a, -1 in b.

    Sketches are subtracted cell by cell and peeled, with larger tables until
    nothing is left over. Null texts count as empty; ids must be distinct.
    """
    text = lambda c: paragraphs(F.coalesce(F.col(c), F.lit("")))
    sets = materialize(pairs.select("id", text("a").alias("a"), text("b").alias("b")))
    factor, parts = 1, []
    while not sets.isEmpty():
        width = (F.ceil((F.size("a") + F.size("b")) * 0.2 * factor) + 2).cast("long")
        flat = sets.select("id", width.alias("width"), F.size("a").alias("na"), F.posexplode(F.concat("a", "b")).alias("pos", "key"))
        signed = flat.withColumn("n", F.when(F.col("pos") < F.col("na"), 1).otherwise(-1).cast("long"))
        cells = _summed(in_three_tables(signed, ["id"]), ["id", "width", "cell"])
        left = materialize(decoded(cells, "id", rounds=rounds, digests=True))
        failed = left.where("cell >= 0").select("id").distinct()
        parts.append(left.join(failed, "id", "left_anti").select("id", F.col("key").alias("digest"), "n"))
        sets = materialize(sets.join(failed, "id", "left_semi"))
        factor *= 2
    return reduce(DataFrame.union, parts) if parts else pairs.sparkSession.createDataFrame([], "id long, digest long, n long")
