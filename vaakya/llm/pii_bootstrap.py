"""Personal data by bootstrapped contextual extraction, in SQL functions alone.

Seeds are what four patterns find (email, ip, card, phone).  The word before a seed makes a
lexical pattern; tokens that look like identifiers and touch neither a seed nor a number that
its kind's check refused are candidates under the same kind of pattern.  Patterns and
instances form a bipartite graph that is scored in rounds: a pattern is as good as the
instances it goes with, an instance as good as its patterns.  A pattern must also be lexical:
of all places where its word stands, whatever follows, a share of LEXICAL goes with seeds, so
common words are never patterns.  Two words before a seed make a pattern as well; its share is
one of different texts and not of places, so copies of a text can't switch it off.  A name with
a sign of assignment after it (``name = "``, ``name: ``) is a third sort of pattern.  Its seeds
are candidates that look like keys, long runs of hexadecimal digits, besides those above; it is
judged by different texts as well.  Candidates under a pattern of high confidence, which at
least MIN_SEEDS different seeds support, become spans of kind ``id``.

Matches are leftmost and do not overlap.  The patterns below state the same matches as the
plain ones in their comments, but start only where a run starts (or where the last match
ended) and never give back, so a text of one long run costs linear time and no stack.

Null text counts as empty and has no spans.  Repeated rows get a row each.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaakya.llm.scratch import materialise
from vaakya.llm.sqlarrays import let, prefix_sums

KINDS = ("email", "ip", "card", "phone")
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier by its looks: letters, a digit, and at least five more.
TOKEN = r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z]*+[0-9][A-Za-z0-9_-]{5,}+"

#: A key by its looks: a seed where it is assigned to a name.
KEY = r"^[0-9A-Fa-f]{32,}$"
#: A name and a sign of assignment.
ASSIGNED = r"([\p{L}_]+)[\x20]{0,2}[=:][\x20]{0,2}[\"']?"

ROUNDS = 3
MIN_SEEDS = 3
CONFIDENCE = 0.8
LEXICAL = 0.05
#: How many characters before a span its context word is looked for in.
REACH = 48


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found, left>> of all matches; places are code points."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(p: Column, m: Column) -> Column:
        spent = F.transform(m, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long"))
        return F.zip_with(
            F.transform(prefix_sums(spent), lambda s, i: s + F.length(F.get(p, i))),
            F.transform(m, lambda x, i: F.struct(x.alias("x"), F.right(F.get(p, i), F.lit(REACH)).alias("left"))),
            lambda s, x: F.struct(
                s.alias("start"), (s + F.length(x["x"])).alias("end"), x["x"].alias("found"), x["left"].alias("left")
            ),
        )

    return let(pieces, lambda p: let(matches, lambda m: spans(p, m)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _byte(part: Column) -> Column:
    """Whether a run of digits is 255 at most, however many digits it has."""
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.lpad(short, 3, "0") <= "255")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), _byte)
    n = F.length(_digits(x))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _refused(kind: str, x: Column) -> Column:
    """Whether a match that is not valid has the form of its kind all the same."""
    return {"ip": F.lit(True), "card": F.length(_digits(x)).between(12, 19)}.get(kind, F.lit(False))


def _of_kind(hits: Column, kind: str, rank: int) -> Column:
    """Valid and refused matches as struct<start, rank, end, kind, found, left, valid>."""
    return F.transform(
        F.filter(hits, lambda s: _valid(kind, s["found"]) | _refused(kind, s["found"])),
        lambda s: F.struct(
            s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(kind).alias("kind"), s["found"], s["left"], _valid(kind, s["found"]).alias("valid")
        ),
    )


def matches(text: Column) -> Column:
    """Matches of the four kinds, valid and refused, by start and then kind."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,found:string,left:string>>")
    # what a text must have for a kind at all spares most texts the search
    needs = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }
    parts = []
    for rank, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        hits = F.when(needs[kind], _found(text, pattern)).otherwise(empty)
        parts.append(_of_kind(hits, kind, rank))
    return F.array_sort(F.concat(*parts))


def _candidates(text: Column, spans: Column) -> Column:
    """Identifier-like tokens that touch none of the spans: what a check refused stays out too."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,found:string,left:string>>")
    hits = F.when(text.rlike("[0-9]"), _found(text, TOKEN)).otherwise(empty)
    clear = lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return F.filter(hits, clear)


def pattern_of(x: Column) -> Column:
    """The word before a span; its last letters only, in lower case."""
    return F.lower(F.regexp_extract(x["left"], r"([\p{L}]+)[^\p{L}]{0,6}$", 1))


def pair_of(x: Column) -> Column:
    """The two words before a span, as :func:`pattern_of` has one; empty where there are no two."""
    two = r"([\p{L}]+)[^\p{L}]{1,6}([\p{L}]+)[^\p{L}]{0,6}$"
    part = lambda k: F.regexp_extract(x["left"], two, k)
    return F.when(part(1) != "", F.lower(F.concat(part(1), F.lit(" "), part(2)))).otherwise(F.lit(""))


def assigned_of(x: Column) -> Column:
    """The name a span is assigned to, in lower case and with ``=`` after it; empty where there is none."""
    name = F.regexp_extract(x["left"], ASSIGNED + "$", 1)
    return F.when(name != "", F.lower(F.concat(name, F.lit("=")))).otherwise(F.lit(""))


PATTERNS = (pattern_of, pair_of, assigned_of)


def _edges(found: DataFrame) -> DataFrame:
    """pattern, instance, n, seed: occurrences counted, one row a pair."""
    edge = lambda column, seed, of: F.transform(
        column,
        lambda s: F.struct(of(s).alias("pattern"), F.xxhash64(s["found"]).alias("instance"), seed(s).cast("int").alias("seed")),
    )
    is_seed = {"base": lambda of: lambda s: F.lit(1), "others": lambda of: lambda s: s["found"].rlike(KEY) if of is assigned_of else F.lit(0)}
    both = F.concat(*[edge(F.col(c), seed(of), of) for c, seed in is_seed.items() for of in PATTERNS])
    return found.select(F.inline(both)).where("pattern != ''").groupBy("pattern", "instance", "seed").count()


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence, seeds (different ones) and seed_places.  Seeds hold a score of 1; others start at 0.

    A round: a pattern's confidence is the mean score of its occurrences; an instance's score
    is the mean confidence of its patterns, by occurrences.
    """
    score = F.col("seed").cast("double")
    places = F.sum(F.col("seed") * F.col("count")).alias("seed_places")
    seeds = edges.groupBy("pattern").agg(F.sum("seed").alias("seeds"), places)
    now = edges.withColumn("score", score)
    for k in range(rounds):
        patterns = now.groupBy("pattern").agg((F.sum(F.col("score") * F.col("count")) / F.sum("count")).alias("confidence"))
        if k + 1 == rounds:
            break
        with_confidence = edges.join(patterns, "pattern")
        instances = with_confidence.where("seed = 0").groupBy("instance").agg(
            (F.sum(F.col("confidence") * F.col("count")) / F.sum("count")).alias("mean")
        )
        now = materialise(
            edges.join(instances, "instance", "left").withColumn(
                "score", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.coalesce("mean", F.lit(0.0)))
            ).drop("mean"),
            "graph",
        )
    return patterns.join(seeds, "pattern")


def lexical(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns whose word stands before seeds in a share of LEXICAL of all its places."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("pattern"))
    places = found.groupBy("pattern").agg(F.count("*").alias("places"))
    return patterns.join(places, "pattern").where(F.col("seed_places") >= LEXICAL * F.col("places"))


def _of_texts(every: DataFrame, seeds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns that stand before seeds in a share of LEXICAL of all different texts they stand in."""
    count = lambda rows, name: (
        rows.join(patterns.select("pattern"), "pattern", "left_semi").distinct().groupBy("pattern").agg(F.count("*").alias(name))
    )
    both = count(every, "texts").join(count(seeds, "seed_texts"), "pattern")
    return patterns.join(both, "pattern").where(F.col("seed_texts") >= LEXICAL * F.col("texts"))


def _pairs_in(text: Column) -> Column:
    """Different pairs of words that follow each other in a text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    two = lambda w: F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.array_distinct(let(words, two))


def possible_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs that :func:`_of_texts` may pass: they do among texts with seeds alone, whose share of texts is higher."""
    texts = found.where("held is not null").dropDuplicates(["_text"])
    counts = texts.select(F.explode("held").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("texts"))
    before = F.array_distinct(F.transform("base", pair_of))
    seeds = texts.select(F.explode(before).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("seed_texts"))
    both = pairs.join(counts, "pattern").join(seeds, "pattern")
    return both.where(F.col("seed_texts") >= LEXICAL * F.col("texts")).select(*pairs.columns)


def lexical_pairs(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Patterns of two words that pass :func:`_of_texts`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select(F.xxhash64(text).alias("_text"), F.explode(_pairs_in(text)).alias("pattern"))
    seeds = found.select("_text", F.explode(F.array_distinct(F.transform("base", pair_of))).alias("pattern"))
    return _of_texts(every, seeds, pairs)


def lexical_names(docs: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """Patterns of a name and a sign of assignment that pass :func:`_of_texts`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.regexp_extract_all(F.lower(text), F.lit(ASSIGNED), F.lit(1))
    every = docs.where(text.rlike("[=:]")).select(
        F.xxhash64(text).alias("_text"), F.explode(F.array_distinct(F.transform(held, lambda x: F.concat(x, F.lit("="))))).alias("pattern")
    )
    keys = F.concat(F.col("base"), F.transform(F.filter("others", lambda s: s["found"].rlike(KEY)), lambda s: _as_base(s)))
    seeds = found.select("_text", F.explode(F.array_distinct(F.transform(keys, assigned_of))).alias("pattern"))
    return _of_texts(every, seeds, names)


def _as_base(s: Column) -> Column:
    """A candidate in the form of ``base``."""
    return F.struct(
        s["start"], F.lit(len(KINDS)).alias("rank"), s["end"], F.lit("id").alias("kind"), s["found"], s["left"], F.lit(True).alias("valid")
    )


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, ``base`` and ``extra`` span arrays, and the columns of ``keep``."""
    keep = keep or []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("_id"), text.alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = base.withColumn("_hits", matches(F.col("_text")))
    base = base.withColumns({"base": F.filter("_hits", lambda s: s["valid"]), "others": _candidates(F.col("_text"), F.col("_hits"))})
    # pairs of the texts with seeds, a few of all, tell which patterns of two words may pass at all
    base = base.withColumn("held", F.when(F.size("base") > 0, _pairs_in(F.col("_text"))))
    found = materialise(base.withColumn("_text", F.xxhash64("_text")).drop("_hits").withColumn("_row", F.monotonically_increasing_id()), "found")
    edges = materialise(_edges(found), "edges")
    sure = score_patterns(edges).where((F.col("confidence") >= CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS))
    sure = materialise(sure, "patterns")
    names = sure.where("endswith(pattern, '=')")
    pairs = sure.where("contains(pattern, ' ') and not endswith(pattern, '=')")
    single = sure.where("not contains(pattern, ' ') and not endswith(pattern, '=')")
    good = docs.sparkSession.createDataFrame([], "pattern string")
    # texts are looked at again only for patterns there are
    if not single.isEmpty():
        good = good.union(lexical(docs, single).select("pattern"))
    if not pairs.isEmpty():
        pairs = materialise(possible_pairs(found, pairs), "patterns")
    if not pairs.isEmpty():
        good = good.union(lexical_pairs(docs, found, pairs).select("pattern"))
    if not names.isEmpty():
        good = good.union(lexical_names(docs, found, names).select("pattern"))
    others = found.where(F.size("others") > 0).select("_row", F.explode("others").alias("s"))
    others = others.select("_row", "s", F.explode(F.array(*[of(F.col("s")) for of in PATTERNS])).alias("pattern"))
    extra = (
        others.join(good, "pattern")
        .groupBy("_row")
        # a row's own candidates alone meet here
        .agg(F.array_sort(F.collect_set(F.struct("s.start", "s.end"))).alias("extra"))
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return found.join(extra, "_row", "left").select(
        F.col("_id").alias("doc_id"),
        "base",
        F.coalesce("extra", empty).alias("extra"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def all_spans() -> Column:
    """``base`` and ``extra`` of :func:`find` as struct<start, rank, end, kind>, in order."""
    plain = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    more = F.transform("extra", lambda s: F.struct(s["start"], F.lit(len(KINDS)).alias("rank"), s["end"], F.lit("id").alias("kind")))
    return F.array_sort(F.concat(plain, more))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, and all spans as text."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[number(kind) for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(all_spans()).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by ``<KIND>`` of its first."""

    def merge(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(last["start"], F.greatest(last["end"], s["end"]).alias("end"), last["kind"])
        own = F.struct(s["start"], s["end"], s["kind"])
        return F.when((F.size(a) > 0) & (s["start"] < last["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(
            F.concat(a, F.array(own))
        )

    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    runs = F.aggregate(spans, empty, merge)

    def rewrite(r: Column) -> Column:
        before = F.transform(
            r,
            lambda s, i: F.concat(
                F.substr(text, (F.coalesce(F.get(r, i - 1)["end"], F.lit(0)) + 1).cast("int"), (s["start"] - F.coalesce(F.get(r, i - 1)["end"], F.lit(0))).cast("int")),
                F.lit("<"),
                F.upper(s["kind"]),
                F.lit(">"),
            ),
        )
        tail = F.substr(text, (F.element_at(r, -1)["end"] + 1).cast("int"))
        return F.concat(F.array_join(before, ""), tail)

    return let(runs, lambda r: F.when(F.size(r) > 0, rewrite(r)).otherwise(text))
