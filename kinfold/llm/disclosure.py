"""Personal data, and the terms that give it away: information-theoretic sanitisation.

E-mail and IP addresses, card and phone numbers are found by patterns; their values are
the protected entities. How much a term discloses of an entity e is estimated from the
corpus: the pointwise mutual information log2(N n(e, t) / (n(e) n(t))) as a share of
what there is to know about e, log2(N / n(e)). n(e) and n(t) are the documents that
hold them, n(e, t) those where t stands within a few words of e. A term that reveals an
entity reveals it wherever it stands, so terms over the threshold are marked in all
documents: removed if they tell nearly everything, else generalised to their class. A
pair has to be seen in several different texts; words of one text, or of its exact
copies, always stand together and prove nothing.

DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..operators.sketch import key_sketch
from ..session import materialize

# The patterns of the base kinds in their order. They match what the plain
# forms match; possessive parts and the look at the character before only save steps.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = [*PATTERNS, "term"]
TERM = len(PATTERNS)
WORD_CHAR = r"[\p{L}\p{M}\p{N}]"
WORD = WORD_CHAR + "+"

NEAR_WORDS, NEAR_CHARS = 5, 256  # how far from an entity a word still stands with it
SHORTEST = 3  # characters of a term
SUPPORT = 3  # different texts in which a term has to stand near an entity
GENERALISE, REMOVE = 0.7, 0.9  # of the information about an entity
PART = 16  # one document in so many gives the first bound of a frequency
BLOCK = 64  # of `starts`


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: what a lambda's body or several
    branches name would else be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def starts(gaps: Column, lengths: Column) -> Column:
    """Where each match begins, from the lengths of the gaps before it and of the
    matches. Sums run inside blocks and over blocks, so that growing arrays stay short."""
    pairs = F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n")))

    def over_blocks(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, _sums(F.lit(0), "array<array<int>>"), _block)["out"])

    # The gap after the last match has no match; it adds a place that is not looked at.
    return let(pairs, over_blocks)


def _sums(at: Column, kind: str) -> Column:
    return F.struct(at.cast("int").alias("at"), F.array().cast(kind).alias("out"))


def _block(total: Column, block: Column) -> Column:
    def step(sums: Column, s: Column) -> Column:
        begin = (sums["at"] + s["g"]).cast("int")
        return F.struct((begin + s["n"]).alias("at"), F.concat(sums["out"], F.array(begin)).alias("out"))

    inner = F.aggregate(block, _sums(total["at"], "array<int>"), step)
    return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(total["out"], F.array(x["out"])).alias("out")))


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.length(t))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    places = F.sequence(F.lit(0), F.length(number) - 1)

    def weighed(total: Column, k: Column) -> Column:
        digit = F.substring(number, F.length(number) - k, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(k % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), weighed) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the pattern counts."""
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _is_term(word: Column) -> Column:
    return (F.length(word) >= SHORTEST) & word.rlike(r"\p{L}")


def _around(before: Column, after: Column) -> Column:
    """Distinct lower-case words on both sides of a span, without other personal data.
    A word that the outermost character cuts is left out."""
    whole = "|".join(f"(?:{p})" for p in PATTERNS.values())
    left = F.substring(before, -NEAR_CHARS, NEAR_CHARS)
    left = F.when(F.length(before) > NEAR_CHARS, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)
    right = F.substring(after, 1, NEAR_CHARS)
    right = F.when(F.length(after) > NEAR_CHARS, F.regexp_replace(right, f"{WORD}$", "")).otherwise(right)
    left, right = (words(F.lower(F.regexp_replace(x, whole, " "))) for x in (left, right))
    some = F.concat(F.slice(F.reverse(left), 1, NEAR_WORDS), F.slice(right, 1, NEAR_WORDS))
    return F.filter(F.array_distinct(some), _is_term)


BASE = "array<struct<kind:int,start:int,stop:int,value:string,near:array<string>>>"


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text, base), a written table: the spans of the base kinds as an array of
    (kind, start, stop, value, near), by kind and start; `row` is unique."""
    text = F.coalesce(df[text_col], F.lit(""))
    staged = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("id"), text.alias("text"))
    for kind, pattern in PATTERNS.items():
        staged = staged.withColumn(f"found_{kind}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    for kind, pattern in PATTERNS.items():
        there = F.size(f"found_{kind}") > 0
        staged = staged.withColumn(f"gaps_{kind}", F.when(there, F.split("text", pattern, -1)))
        staged = staged.withColumn(
            f"starts_{kind}",
            F.when(there, starts(_lengths(F.col(f"gaps_{kind}")), _lengths(F.col(f"found_{kind}")))),
        )
    kinds = [_spans_of(number, kind) for number, kind in enumerate(PATTERNS)]
    return materialize(staged.select("row", "id", "text", F.concat(*kinds).alias("base")), "pii-base")


def _spans_of(number: int, kind: str) -> Column:
    found, gaps = F.col(f"found_{kind}"), F.col(f"gaps_{kind}")
    # Zipped, since what a lambda's body names is computed once per element.
    parts = F.arrays_zip(found, F.col(f"starts_{kind}"), F.slice(gaps, 1, F.size(found)), F.slice(gaps, 2, F.size(found)))
    parts = parts.cast("array<struct<value:string,start:int,before:string,after:string>>")

    def span(s: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"),
            s["start"].alias("start"),
            (s["start"] + F.length(s["value"])).alias("stop"),
            s["value"].alias("value"),
            _around(s["before"], s["after"]).alias("near"),
        )

    counted = F.transform(F.filter(parts, lambda s: s["value"].isNotNull() & valid(kind, s["value"])), span)
    return F.when(F.size(found) > 0, counted).otherwise(F.array().cast(BASE))


def disclosing_terms(
    staged: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT
) -> DataFrame:
    """(term, entity, disclosure, removed): the terms over the threshold, each with the
    entity of which it tells most. A written table of one row per term.

    Document frequencies are counted over all words of all documents, for the terms that
    stand near an entity in enough texts and may still reach the threshold. A term is in
    at least as many documents as it stands in near any entity, and as many as it is in
    of a part of the documents: common words are over what the threshold allows by
    these bounds, and the last count is of rare ones. A sketch of them of a fixed size
    lets few other words out of the scan. An entity in all documents is no secret and
    protects nothing.
    """
    total = staged.count()
    marks = staged.filter(F.size("base") > 0).select("row", F.xxhash64("text").alias("body"), F.explode("base").alias("s"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("s.kind") + 1)
    entity = F.concat_ws(":", kind, F.lower("s.value")).alias("entity")
    marks = materialize(marks.select("row", "body", entity, F.col("s.near").alias("near")), "pii-marks")
    entities = marks.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = marks.select("entity", "row", "body", F.explode("near").alias("term")).distinct()
    pairs = pairs.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_both"), F.countDistinct("body").alias("n_texts")
    )
    near = marks.select("row", F.explode("near").alias("term")).distinct()
    near = near.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = pairs.filter(F.col("n_texts") >= support).join(entities.filter(F.col("n_entity") < total), "entity")
    pairs = pairs.join(near, "term").filter(_disclosure(total, "n_near") >= generalise)
    pairs = materialize(pairs.withColumnRenamed("n_near", "n_term"), "pii-pairs")
    part = staged.filter(F.pmod(F.xxhash64("row"), F.lit(PART)) == 0)
    pairs = pairs.join(_frequencies(part, pairs), "term", "left")
    pairs = pairs.withColumn("n_term", F.greatest("n_term", F.coalesce("n_documents", F.lit(0)))).drop("n_documents")
    pairs = materialize(pairs.filter(_disclosure(total, "n_term") >= generalise), "pii-rare")
    both = pairs.drop("n_term").join(_frequencies(staged, pairs).withColumnRenamed("n_documents", "n_term"), "term")
    share = _disclosure(total, "n_term").alias("disclosure")
    most = both.select("term", "entity", share).filter(F.col("disclosure") >= generalise)
    most = most.groupBy("term").agg(F.max(F.struct("disclosure", "entity")).alias("m"))
    out = most.select("term", "m.entity", "m.disclosure", (F.col("m.disclosure") >= remove).alias("removed"))
    return materialize(out, "pii-terms")


def _frequencies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(term, n_documents) of the pairs' terms that are words of these documents."""
    terms = pairs.select("term").distinct()
    sketch = key_sketch(terms, "term")
    if not sketch.n_set:
        return terms.withColumn("n_documents", F.lit(0).cast("long"))
    distinct = F.array_distinct(words(F.lower("text")))
    known = docs.select(F.explode(F.filter(distinct, lambda w: sketch.may_hold(w))).alias("term"))
    return known.groupBy("term").agg(F.count(F.lit(1)).alias("n_documents")).join(terms, "term")


def _disclosure(total: int, n_term: str) -> Column:
    """Mutual information of a pair, for a term in so many documents, as a share of what
    the entity holds."""
    told = F.log2(total * F.col("n_both") / (F.col(n_term) * F.col("n_entity")))
    return told / F.log2(total / F.col("n_entity"))


def personal_data(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    support: int = SUPPORT,
) -> DataFrame:
    """(id, spans, sanitised), a row per input row. `spans` is an array of (kind, start,
    stop, label), kinds as numbered in KINDS, by kind and start; `sanitised` is the text
    with every span replaced by its label; removed terms leave nothing.

    Null and empty texts have no spans; rows that repeat are handled each by itself. A
    term inside a base span is not marked again. An empty table gives no rows. In texts
    with very many spans the sanitised text costs their number times its length.
    """
    staged = base_spans(df, id_col, text_col)
    flagged = disclosing_terms(staged, generalise, remove, support)
    # The number only decides whether texts are read once more.
    sketch = key_sketch(flagged, "term")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    base = F.transform("base", lambda s: _span(s["kind"], s["start"], s["stop"], F.element_at(labels, s["kind"] + 1)))
    if not sketch.n_set:
        rows = staged.select("id", "text", base.alias("spans"))
    else:
        marked = _term_spans(staged, flagged, sketch)
        joined = staged.join(marked, "row", "left")
        apart = F.filter(
            F.coalesce("terms", F.array().cast(SPANS)),
            lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
        )
        rows = joined.select("id", "text", F.concat(base, apart).alias("spans"))
    return rows.select("id", "spans", _sanitised(F.col("text"), F.col("spans")).alias("sanitised"))


SPANS = "array<struct<kind:int,start:int,stop:int,label:string>>"


def _span(kind: Column, start: Column, stop: Column, label: Column) -> Column:
    return F.struct(kind.alias("kind"), start.alias("start"), stop.alias("stop"), label.alias("label"))


def _term_spans(staged: DataFrame, flagged: DataFrame, sketch) -> DataFrame:
    """(row, terms): the marked words of the documents that have any."""
    some = F.filter(words(F.col("text")), lambda w: sketch.may_hold(F.lower(w)))
    found = staged.select("row", "text", F.array_distinct(some).alias("some"))
    # Only the words that may be terms, spelt as they stand here, are looked for once more.
    whole = F.concat(F.lit(f"(?<!{WORD_CHAR})(?:"), F.array_join("some", "|"), F.lit(f")(?!{WORD_CHAR})"))

    def placed(match: Column) -> Column:
        begin = starts(_lengths(F.split("text", whole, -1)), _lengths(match))
        return F.zip_with(match, begin, lambda w, at: F.struct(w.alias("word"), at.alias("start")))

    places = F.when(F.size("some") > 0, let(F.regexp_extract_all("text", whole, F.lit(0)), placed))
    # Outer, as an inner explode would have the array computed a second time to filter by.
    hits = found.select("row", F.explode_outer(places).alias("p")).filter("p.word IS NOT NULL")
    hits = hits.select("row", F.lower("p.word").alias("term"), "p.word", "p.start")
    hits = materialize(hits, "pii-hits")
    hits = skew_join(hits, flagged.select("term", "removed"), ["term"], ["row"])
    shape = F.when(F.col("word").rlike(r"\p{N}"), "[NUMBER]").when(F.col("word").rlike(r"^\p{Lu}"), "[NAME]")
    label = F.when(F.col("removed"), "").otherwise(shape.otherwise("[WORD]"))
    span = _span(F.lit(TERM), F.col("start"), F.col("start") + F.length("word"), label)
    return hits.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("terms"))


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with spans replaced; of spans that overlap, the first one's label stands."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["label"].alias("label")))
    )

    def step(done: Column, s: Column) -> Column:
        between = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        out = F.concat(done["out"], between, s["label"])
        fresh = F.struct(s["stop"].alias("at"), out.alias("out"))
        longer = F.struct(F.greatest(done["at"], s["stop"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(longer)

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def written(spans: Column, base_only: bool = False) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    some = F.filter(spans, lambda s: s["kind"] < TERM) if base_only else spans
    parts = F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"]))
    return F.array_join(parts, ",")


def _count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    spans = F.col("spans")
    counts = [_count(spans, number).alias(f"n_{kind}") for number, kind in enumerate(PATTERNS)]
    digest = F.sha2(written(spans, base_only=True), 256).alias("base_sha256")
    return found.select("id", *counts, digest, written(spans).alias("spans"))
