"""Personal data: pattern spans, and terms that reveal them, in DataFrame functions only.

A term reveals an entity as far as lines that hold the term also hold the
entity. With occurrence counts over all lines of the corpus, the disclosure of
entity e by term t is the pointwise mutual information of both over the
information of e: log(P(e|t) / P(e)) / -log P(e). It is 1 if the term never
stands in a line without the entity, and 0 if both are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoflow.llm.common import BROADCAST_ROWS, null_back, small, texts
from nucleoflow.session import materialize

#: Fixed patterns, in the order of the kinds. Loops are possessive where nothing
#: could be given back, and a run is entered at its start only, so that matching
#: takes linear time and no stack; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][ -]))[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before the pattern is tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][0-9 -]{12,}[0-9]", "phone": r"\+[0-9]"}
KINDS = [*PATTERNS, "term"]
#: Scripts written without spaces; a term is one to three neighbouring characters of them,
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
RUN = f"[{UNSPACED}]++"
NEIGHBOURS = 3
#: elsewhere a run of letters and digits.
TERM = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]++"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Least number of lines, copies included, in which a term and an entity must meet.
SUPPORT = 3
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.99
GENERAL = "[TERM]"


def _places(text: Column, pattern: str, wanted=None) -> Column:
    """Array of (start, end, match) in code points, from the matches and the gaps between them; of ``wanted`` matches only."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        here = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        out = F.concat(acc["out"], F.array(here))
        return F.struct(end.alias("at"), (out if wanted is None else F.when(wanted(pair["match"]), out).otherwise(acc["out"])).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, nine less if above nine; the sum ends in 0."""
    backwards = F.reverse(digits)

    def step(total: Column, k: Column) -> Column:
        d = F.substring(backwards, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.substring(number(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _named(kind: str, spans: Column) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), s["end"].alias("end"), s["match"].alias("match"))
    )


NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int,match:string>>)"


def kind_spans(text: Column, kind: str) -> Column:
    """Spans (start, kind, end, match) of one kind; matches that fail its test are dropped."""
    hint = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
    valid = F.filter(_places(text, PATTERNS[kind]), lambda s: _valid(kind, s["match"]))
    return F.when(hint, _named(kind, valid)).otherwise(F.expr(NO_SPANS))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[kind_spans(text, k) for k in PATTERNS]))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def entity(span: Column) -> Column:
    """Name under which equal entities are counted together."""
    number = span["kind"] >= 2
    value = F.when(number, _digits(span["match"])).otherwise(F.lower(span["match"]))
    return F.concat_ws(":", span["kind"], value)


def _parts(run: Column, at: Column) -> Column:
    """Array of (start, end, match) of all terms in a run of unspaced characters that starts at ``at``."""
    part = lambda i, n: F.struct((at + i - 1).alias("start"), (at + i - 1 + n).alias("end"), F.substring(run, i, n).alias("match"))
    lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(NEIGHBOURS), F.length(run) - i + 1))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.transform(lengths(i), lambda n: part(i, n))))


def terms_of(line: Column) -> Column:
    low = F.lower(line)
    words = F.regexp_extract_all(low, F.lit(TERM), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(RUN), F.lit(0))
    more = F.flatten(F.transform(runs, lambda r: F.transform(_parts(r, F.lit(0)), lambda p: p["match"])))
    return F.array_distinct(F.when(low.rlike(RUN), F.concat(words, more)).otherwise(words))


def _term_spans(text: Column, terms: Column) -> Column:
    """(start, end, match) of the places of ``terms`` in a text."""
    words = _places(text, TERM, lambda m: F.array_contains(terms, F.lower(m)))
    parts = F.flatten(F.transform(_places(text, RUN), lambda r: _parts(r["match"], r["start"])))
    parts = F.filter(parts, lambda p: F.array_contains(terms, F.lower(p["match"])))
    return F.when(text.rlike(RUN), F.concat(words, parts)).otherwise(words)


def _outside(line: Column, spans: Column) -> Column:
    """The line with a space for each of its spans."""

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(line, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before, F.lit(" ")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(line, acc["at"] + 1, F.length(line))))


def revealing(rows: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of the pairs that reach ``least``; rows have column text."""
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line"))
    hint = F.col("line").contains("@") | F.col("line").rlike("|".join(HINTS[k] for k in ("ip", "card", "phone")))
    spans = lines.where(hint).select("line", base_spans(F.col("line")).alias("base"))
    outside = terms_of(_outside(F.col("line"), F.col("base")))
    named = spans.select(F.array_distinct(F.transform("base", entity)).alias("entities"), outside.alias("terms"))
    named = materialize(named.where(F.size("entities") > 0))
    by_entity = materialize(named.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")))
    met = named.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    pairs = materialize(met.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support))
    wanted = materialize(pairs.select("term").distinct())
    total = rows.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 1
    # what stands inside an entity is no term anywhere, so both counts are of the same texts
    words = lines.where(~hint).select(F.explode(terms_of(F.col("line"))).alias("term"))
    words = words.union(spans.select(F.explode(outside).alias("term")))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_term = words.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        by_term = words.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    all_counts = pairs.join(by_term, "term").join(by_entity, "entity")
    share = F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))
    known = F.log(F.lit(float(total)) / F.col("n_e"))
    disclosure = F.when(known > 0, 1 + F.log(share) / known).otherwise(F.lit(0.0))
    return materialize(all_counts.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= least))


def found(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(doc_id, text, base, spans, removed) of every row.

    base holds the pattern spans, spans also those of revealing terms in texts
    that hold the entity they reveal; removed lists the terms to remove rather
    than to generalise. Null texts count as empty. Equal rows give equal
    results. An empty table gives no rows.
    """
    rows = texts(docs)
    risky = revealing(rows, support, least)
    keyed = rows.select("doc_id", F.xxhash64("text").alias("name"), "text", base_spans(F.col("text")).alias("base"))
    empty = F.expr("cast(array() as array<string>)")
    if risky.isEmpty():
        return keyed.select("doc_id", "text", "base", F.col("base").alias("spans"), empty.alias("removed"))
    held = keyed.where(F.size("base") > 0).select("doc_id", "name", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    pairs = held.join(small(risky), "entity").groupBy("doc_id", "name", "term").agg(F.max("disclosure").alias("d"))
    flagged = materialize(
        pairs.groupBy("doc_id", "name").agg(
            F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("d") >= REMOVE, F.col("term"))).alias("removed")
        )
    )
    both = keyed.join(small(flagged), ["doc_id", "name"], "left")
    more = _term_spans(F.col("text"), F.col("terms"))
    apart = F.filter(_named("term", more), lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart)))
    return both.select("doc_id", "text", "base", spans.alias("spans"), F.coalesce("removed", empty).alias("removed"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    rows = found(docs)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select(
        null_back("doc_id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced: by its kind's label, by a general label, or by nothing.

    Of spans that overlap, the first is replaced and those that start inside it go with it.
    """
    labels = F.array(*[F.lit(LABELS.get(k, GENERAL)) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gone = (s["kind"] == len(PATTERNS)) & F.array_contains("removed", F.lower(s["match"]))
        label = F.when(gone, "").otherwise(F.get(labels, s["kind"]))
        before = F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        inside = s["start"] < acc["at"]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], before, label))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return found(docs).select(null_back("doc_id").alias("doc_id"), done.alias("text"))
