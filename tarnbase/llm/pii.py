"""Information-theoretic sanitisation, in SQL expressions only.

Four kinds of personal data are found by rule: email, ip, card and phone.
Their values are the protected entities. A term near an entity reveals it
when their pointwise mutual information comes close to the entity's own
information content: log p(e|t)/p(e) against -log p(e). The estimates count
co-occurrence over the whole corpus: in how many distinct contexts of the
entity the term stands (copies of a passage count once), and in how many
distinct texts it stands at all. Terms whose share exceeds the threshold are
spans of kind "term", wherever in the corpus they stand; sanitising replaces
every span by the name of its kind.

Patterns are written so that no Java group recurses and none retries
quadratically: repeated groups are possessive, and a match that can only
start where a run of its characters starts looks behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbase.llm.common import fingerprint, nested, stage

#: Fixed values of the contract, as possessive patterns with the same matches: kind, pattern, cheap test for whether to look at all.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    ("card", r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9]){11}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
)
_SPAN = "array<struct<s:int,e:int,m:string>>"
#: Broadcast terms only up to this many; a shuffle join serves beyond.
BROADCAST_TERMS = 50_000


def _q(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


#: Elements folded into one array: a fold copies what it has at each step, so long arrays are folded in parts.
FOLD = 256
_PARTS = "transform(sequence(0, cast(greatest(size({0}) - 1, 0) div " + str(FOLD) + " as int)), i -> slice({0}, i * " + str(FOLD) + " + 1, " + str(FOLD) + "))"


def _let(name: str, value: str, body: str) -> str:
    """body with name standing for the value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def matches(text: str, pattern: str, literal: bool = True) -> Column:
    """All matches as (s, e, m): code points from 0, end exclusive. pattern: a regular expression, or the name of a column that holds one."""
    rx = f"'{_q(pattern)}'" if literal else pattern
    pairs = f"zip_with(regexp_extract_all({text}, {rx}, 0), split({text}, {rx}, -1), (m, g) -> struct(m as m, g as g))"
    ahead = "aggregate(transform(p, c -> aggregate(c, 0, (a, x) -> a + length(x.g) + coalesce(length(x.m), 0))), array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    spans = f"""flatten(transform(p, (c, k) -> aggregate(c, struct(o[k] as at, cast(array() as {_SPAN}) as out),
        (a, x) -> if(x.m is null, a, struct(a.at + length(x.g) + length(x.m) as at,
            concat(a.out, array(struct(a.at + length(x.g) as s, a.at + length(x.g) + length(x.m) as e, x.m as m))) as out)),
        a -> a.out)))"""
    return F.expr(_let("z", pairs, _let("p", _PARTS.format("z"), _let("o", ahead, spans))))


_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
_LUHN = """aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, cast(substring({d}, -i, 1) as int),
    if(cast(substring({d}, -i, 1) as int) > 4, cast(substring({d}, -i, 1) as int) * 2 - 9, cast(substring({d}, -i, 1) as int) * 2))) % 10 = 0"""
_DIGITS = r"regexp_replace(x.m, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": f"x.m rlike '^{_q(_OCTET)}(?:\\\\.{_q(_OCTET)}){{3}}$'",
    "card": f"length({_DIGITS}) between 12 and 19 and " + _LUHN.format(d=_DIGITS),
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def base_spans(text: str = "text") -> Column:
    """The rule-based spans of a text: array of (s, k, kind, e, m), by start and then by kind as listed."""
    parts = []
    for k, (kind, pattern, probe) in enumerate(KINDS):
        found = F.when(F.col(text).rlike(probe), matches(text, pattern)).otherwise(F.expr(f"cast(array() as {_SPAN})"))
        parts.append((f"__{kind}", found, f"transform(filter(__{kind}, x -> {_VALID[kind]}), x -> struct(x.s as s, {k} as k, '{kind}' as kind, x.e as e, x.m as m))"))
    return parts


def find(docs: DataFrame) -> DataFrame:
    """(d, text, base): the columns of docs as a struct, the text (empty for null), its rule-based spans."""
    t = docs.select(nested(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = base_spans()
    t = t.withColumns({name: found for name, found, _ in parts})
    return t.select("d", "text", F.expr("array_sort(concat(" + ", ".join(p for _, _, p in parts) + "))").alias("base"))


#: A term: what is left of a word, lower-cased, without punctuation at its ends.
_TERM = r"regexp_replace(lower(w), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '')"
_SPLIT = r"split(text, '[\\x20\\x09-\\x0D]+')"


def _terms(words: str) -> Column:
    return F.expr("array_distinct(filter(transform(" + words + ", w -> " + _TERM + r"), w -> length(w) >= 3 and w rlike '\\p{L}'))")



def disclosing_terms(found: DataFrame, threshold: float = 0.95, support: int = 3, window: int = 8) -> DataFrame:
    """(th, term): terms that disclose some entity of the corpus, with the fingerprints of the texts they stand in.

    found: text, base. A context is up to `window` words on either side of an
    entity, and what is written together with it; entities and pairs in fewer
    than `support` distinct contexts say nothing. All documents are counted.
    """
    hits = found.where("size(base) > 0").select("text", F.explode("base").alias("b"))
    near, space = 24 * window, r"'[\\x20\\x09-\\x0D]+'"
    # so many words mostly lie so near; where they do not, the whole text on that side is split
    left = F.expr(_let("x", f"split(substring(text, greatest(b.s - {near}, 0) + 1, least(b.s, {near})), {space})", f"if(size(x) > {window + 1} or b.s <= {near}, x, split(substring(text, 1, b.s), {space}))"))
    right = F.expr(_let("x", f"split(substring(text, b.e + 1, {near}), {space})", f"if(size(x) > {window + 1} or length(text) <= b.e + {near}, x, split(substring(text, b.e + 1), {space}))"))
    entity = F.concat(F.col("b.kind"), F.lit(":"), F.lower("b.m"))
    text = fingerprint(F.col("text")).alias("th")
    ctx = hits.select(entity.alias("entity"), text, left.alias("l"), right.alias("r"))
    ctx = ctx.withColumn("words", F.expr(f"concat(slice(l, greatest(size(l) - {window}, 1), {window + 1}), slice(r, 1, {window + 1}))"))
    ctx = ctx.groupBy("entity", fingerprint(F.col("words")).alias("c")).agg(F.first("words").alias("words"), F.min("th").alias("th"))
    ctx = stage(ctx.select("entity", "c", "th", _terms("words").alias("terms")), "contexts")
    often = ctx.groupBy("entity").agg(F.count("*").alias("ne")).where(F.col("ne") >= support)
    near_terms = ctx.select("entity", "c", "th", F.explode("terms").alias("term"))
    pairs = near_terms.groupBy("entity", "term").agg(F.count("*").alias("net")).where(F.col("net") >= support).join(often, "entity")
    n = found.select(text).distinct().count()

    def share(nt: str) -> Column:
        return F.log(F.col("net") * n / (F.col("ne") * F.col(nt))) / F.log(F.lit(float(n)) / F.col("ne"))

    # texts among the contexts already bound a term's count from below, which rules out the words that stand everywhere
    least = near_terms.groupBy("term").agg(F.count_distinct("th").alias("lo"))
    pairs = stage(pairs.where(F.col("ne") < n).join(least, "term").where(share("lo") >= threshold).select("term", "net", "ne"), "pairs")
    terms = pairs.select("term").distinct()
    few = terms.count()
    if not few:
        return found.select(text, F.lit("").alias("term")).limit(0)
    words = found.select(text, F.explode(_terms(_SPLIT)).alias("term"))
    stand = stage(words.join(F.broadcast(terms) if few <= BROADCAST_TERMS else terms, "term", "left_semi").distinct(), "stand")
    nt = stand.groupBy("term").agg(F.count("*").alias("nt"))
    told = pairs.join(nt, "term").where(share("nt") >= threshold).select("term").distinct()
    return stage(stand.join(told, "term", "left_semi"), "told")


def all_spans(docs: DataFrame, **options) -> DataFrame:
    """(d, text, base, spans): the columns of docs as a struct, the text (empty for null), the rule-based spans, those and the disclosing terms; both by start and then kind.

    docs: text and any others, whatever their names. Empty texts have none;
    rows that repeat a text each get its spans, and count once; an empty table
    stays empty.
    """
    found = find(docs)
    told = disclosing_terms(found.select("text", "base"), **options)
    empty = F.expr("cast(array() as array<struct<s:int,k:int,kind:string,e:int,m:string>>)")
    if told.isEmpty():
        return found.withColumn("spans", F.col("base"))
    per = told.groupBy("th").agg(F.collect_set("term").alias("terms"))
    rx = F.expr(r"concat('(?iu)(?<![\\p{L}\\p{N}])(?:', array_join(transform(array_sort(terms, (a, b) -> if(length(a) <> length(b), length(b) - length(a), if(a < b, -1, if(a > b, 1, 0)))), t -> concat('\\Q', t, '\\E')), '|'), ')(?![\\p{L}\\p{N}])')")
    per = stage(per.select("th", rx.alias("rx")), "per")
    t = found.withColumn("th", fingerprint(F.col("text"))).join(per, "th", "left")
    t = t.withColumn("told", F.when(F.col("rx").isNotNull(), matches("text", "rx", literal=False)))
    extra = F.coalesce(F.expr(f"transform(told, x -> struct(x.s as s, {len(KINDS)} as k, 'term' as kind, x.e as e, x.m as m))"), empty)
    return t.select("d", "text", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the counts by kind, the digest of the rule-based spans and all spans as text."""
    t = all_spans(docs.select("doc_id", "text"), **options)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k, _, _ in KINDS]
    terms = F.expr("cast(size(filter(spans, x -> x.kind = 'term')) as long)").alias("n_term")
    return t.select("d.doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), terms)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of its text replaced by [KIND]; overlapping spans become one, named by the first. Columns stay, whatever their names; null texts stay null; n_chars, if there, is brought up to date where the text changed."""
    t = all_spans(docs, **options)
    # a span counts if it begins where all before it have ended
    fold = """aggregate(c, struct(o[k] as at, cast(array() as array<string>) as out),
        (a, x) -> if(x.s < a.at, struct(greatest(a.at, x.e) as at, a.out as out),
            struct(x.e as at, concat(a.out, array(substring(text, a.at + 1, x.s - a.at), concat('[', upper(x.kind), ']'))) as out)),
        a -> array_join(a.out, ''))"""
    ahead = "aggregate(p, array(0), (a, c) -> concat(a, array(greatest(element_at(a, -1), array_max(transform(c, x -> x.e))))))"
    built = F.expr(_let("p", _PARTS.format("spans"), _let("o", ahead, f"concat(array_join(transform(p, (c, k) -> {fold}), ''), substring(text, element_at(o, -1) + 1))")))
    new = {"text": F.when(F.size("spans") > 0, built).otherwise(F.col("d.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    return t.select(*[new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])
