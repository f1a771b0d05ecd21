"""Personal data in texts: fixed patterns, and candidates chosen by boosted trees.

Two sets of spans are found for each kind (email, ip, card, phone). The base spans are the matches
of a fixed pattern that pass the kind's test. Beside them a high-recall generator of each kind
proposes further spans, written in other ways (``name at host dot org``, grouped or run-together
digits, numbers without a plus); those of different kinds may overlap. Gradient-boosted trees judge
a candidate by its format (numbers of digits, letters and separators, checksums, the last label)
and its context (neighbouring characters, words before it), and a threshold for each kind, chosen on
held-out candidates so that 98 of 100 that pass are right, selects what is added.

Nothing is labelled by hand. Base spans are the positive examples, each as it stands and rewritten
in the other ways, in its own context; the generators' candidates outside base spans are the
negative ones. The fit uses all candidates of all documents but a fifth, the thresholds those of that
fifth; every text is scored whole.

All of it is column expressions: patterns, spans, features, tree walks and selection run inside the
row, so documents are neither shuffled nor gathered. The patterns are written without backtracking
or recursion, which keeps them linear in the text; places come from the lengths between matches,
added up in blocks, which is near linear in the number of matches. Places count code points.

Defined cases: a null text is empty; an empty text has no spans; repeated rows and null ids are each
returned; a kind without examples of both labels adds nothing; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from authsignal.functions.shared import written
from authsignal.functions.trees import node_table, packed, tree_sums
from authsignal.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
# The fixed patterns in possessive form: no part can match what follows it, so giving characters
# back never helps. A match begins where its first run of characters does, or where the last ended.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?<![{LOCAL}])[A-Za-z0-9][{LOCAL}]{{0,63}}+ ?(?:@|\(at\)|\[at\]|at\b) ?[A-Za-z0-9-]{{1,63}}+"
    r"(?: ?(?:\.|\(dot\)|\[dot\]|dot\b) ?[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?: ?[.,:-] ?|\[\.\]|\(\.\)| dot )[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ ._/-]{1,2}+[0-9]{4}){3}+)(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{1,5}+\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}+\)?){1,6}(?![0-9])",
}
# other ways of writing a base span: (pattern, replacement) pairs, applied in turn
REWRITTEN = {
    "email": ([], [("@", " at "), (r"\.", " dot ")], [("@", "(at)"), (r"\.", "(dot)")], [("@", " @ ")], [("@", "[at]")]),
    "ip": ([], [(r"\.", "[.]")], [(r"\.", " . ")], [(r"\.", "(.)")], [(r"\.", " dot ")]),
    "card": ([], [("[ -]", ""), (r"(\d{4})(?=\d)", "$1.")], [("[ -]", ""), (r"(\d{4})(?=\d)", "$1_")], [("[ -]", "")]),
    "phone": ([], [(r"\+", "")], [(r"\+", "00")], [(r"\+", ""), (r"[ ()]+", "-"), ("^-", "")], [(r"\+", ""), (r"[ ().-]+", ".")]),
}
MASK = "\x00"
STEP = 256  # matches whose places are added up in one go
BEFORE, AFTER = 24, 8  # code points of context
TREES, DEPTH, PRECISION = 20, 4, 0.98
ENDINGS = r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk)$"
WORDS = r"(?i)(mail|contact|phone|tel|call|fax|card|visa|pay|addr|host|server|\bip\b)"


@dataclass(frozen=True)
class Model:
    trees: Column | None  # one constant
    thresholds: dict[str, float]  # by kind; a kind that is missing adds nothing


def running(values: Column, start: Column) -> Column:
    """Running sums of an array, the first one added to ``start``."""

    def add(seen: Column, value: Column) -> Column:
        total = seen["sum"] + value
        return F.struct(total.alias("sum"), F.array_append(seen["all"], total).alias("all"))

    empty = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(values, empty, add, lambda seen: seen["all"])


def with_matches(df: DataFrame, pattern: str, text: str, name: str) -> DataFrame:
    """Adds ``name``, the matches as (start, end, t, before, after), and ``name``_hits and _pieces.

    Each step is a column of its own, so that nothing is computed again for every match. Places come
    from running sums of lengths, in blocks of ``STEP`` matches.
    """
    hits, pieces = f"{name}_hits", f"{name}_pieces"
    any_hit, n = F.size(hits) > 0, F.size(hits)
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(pieces, F.when(any_hit, F.split(text, pattern, -1)))
    lengths = F.zip_with(F.slice(pieces, 1, n), hits, lambda piece, hit: F.length(piece) + F.length(hit))
    df = df.withColumn("_lengths", F.when(any_hit, lengths))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_lengths") - 1) / STEP).cast("int")), lambda k: F.slice("_lengths", k * STEP + 1, F.lit(STEP))
    )
    df = df.withColumn("_blocks", F.when(any_hit, blocks))
    totals = F.transform("_blocks", lambda block: F.aggregate(block, F.lit(0), lambda a, b: a + b))
    starts = F.concat(F.array(F.lit(0)), running(totals, F.lit(0)))
    df = df.withColumn("_starts", F.when(any_hit, F.slice(starts, 1, F.size("_blocks"))))
    df = df.withColumn("_ends", F.when(any_hit, F.flatten(F.zip_with("_blocks", "_starts", running))))
    parts = F.arrays_zip(
        F.col("_ends").alias("end"), F.col(hits).alias("t"), F.slice(pieces, 1, n).alias("before"), F.slice(pieces, 2, n).alias("after")
    )

    def span(m: Column) -> Column:
        return F.struct(
            (m["end"] - F.length(m["t"])).alias("start"),
            m["end"].alias("end"),
            m["t"].alias("t"),
            F.right(m["before"], F.lit(BEFORE)).alias("before"),
            F.left(m["after"], F.lit(AFTER)).alias("after"),
        )

    none = F.array().cast("array<struct<start:int,end:int,t:string,before:string,after:string>>")
    return df.withColumn(name, F.when(any_hit, F.transform(parts, span)).otherwise(none)).drop("_lengths", "_blocks", "_starts", "_ends")


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit fits, for a text of digits."""

    def value(k: Column) -> Column:
        d = F.substr(number, -k, F.lit(1)).cast("int")
        return F.when(k % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, k: total + value(k)) % 10 == 0


def byte_sized(number: Column) -> Column:
    """At most 255, for a text of digits of any length."""
    short = F.ltrim(number, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def passes(kind: str, t: Column) -> Column:
    """The test that a match of the fixed pattern must pass."""
    if kind == "ip":
        return F.forall(F.split(t, r"\."), byte_sized)
    if kind == "card":
        return F.when(F.length(digits(t)).between(16, 19), luhn(digits(t))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(t)).between(8, 15)
    return F.lit(True)


def with_spans(df: DataFrame) -> DataFrame:
    """Adds base_<kind> and, from the text outside these, wider_<kind>, for all kinds."""
    for kind in KINDS:
        found, masked = f"base_{kind}", f"masked_{kind}"
        df = with_matches(df, BASE[kind], "text", found)
        hidden = F.zip_with(
            f"{found}_pieces",
            f"{found}_hits",
            lambda piece, hit: F.concat(piece, F.when(hit.isNull(), "").when(passes(kind, hit), F.repeat(F.lit(MASK), F.length(hit))).otherwise(hit)),
        )
        df = df.withColumn(masked, F.when(F.size(f"{found}_hits") > 0, F.array_join(hidden, "")).otherwise(F.col("text")))
        df = df.withColumn(found, F.filter(found, lambda m: passes(kind, m["t"]))).drop(f"{found}_hits", f"{found}_pieces")
        df = with_matches(df, WIDER[kind], masked, f"wider_{kind}").drop(masked, f"wider_{kind}_hits", f"wider_{kind}_pieces")
    return df


def neighbour(c: Column) -> Column:
    """Class of one character: none, blank, digit, letter, other."""
    return (
        F.when(c == "", 0.0).when(c.rlike(r"^\s"), 1.0).when(c.rlike("^[0-9]"), 2.0).when(c.rlike("^[A-Za-z]"), 3.0).otherwise(4.0)
    )


def features(kind: str, t: Column, before: Column, after: Column) -> Column:
    """Format and context of one candidate."""
    number = digits(t)
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    groups = F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    return F.array(
        F.lit(float(KINDS.index(kind))),
        F.length(t).cast("double"),
        F.length(number).cast("double"),
        count("[^A-Za-z]"),
        count("[^ ]"),
        count(r"[^.,:/_()\[\]-]"),
        F.size(groups).cast("double"),
        yes(t.contains("+")),
        yes(t.contains("@")),
        F.coalesce(F.left(number, F.lit(1)).try_cast("double"), F.lit(-1.0)),
        neighbour(F.right(before, F.lit(1))),
        neighbour(F.left(after, F.lit(1))),
        yes(before.rlike(WORDS)),
        yes(F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))),
        yes((F.size(groups) == 4) & F.forall(groups, byte_sized)),
        yes(t.rlike(ENDINGS)),
        yes(t.rlike(r"(?i)[( \[](at|dot)[) \]]")),
        F.length(F.regexp_extract(t, "[A-Za-z]*$", 0)).cast("double"),
        yes(t.rlike("[.] ?[A-Z]")),
        F.length(F.regexp_extract(t, "[0-9]*$", 0)).cast("double"),
    )


def rewritten(t: Column, changes: list[tuple[str, str]]) -> Column:
    for pattern, by in changes:
        t = F.regexp_replace(t, pattern, by)
    return t


def example(kind: str, label: int, changes: list[tuple[str, str]]):
    """A function of a match that gives its row of the training table."""

    def row(m: Column) -> Column:
        x = features(kind, rewritten(m["t"], changes), m["before"], m["after"])
        return F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), x.alias("x"))

    return row


def examples(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, label, x) of all candidates of some documents, base spans in all writings."""
    found = []
    for kind in KINDS:
        found += [F.transform(f"base_{kind}", example(kind, 1, changes)) for changes in REWRITTEN[kind]]
        found.append(F.transform(f"wider_{kind}", example(kind, 0, [])))
    return with_spans(docs).select("doc_id", F.inline(F.concat(*found)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit trees and thresholds on all candidates of all documents; those whose ids leave 0 are held out of the fit."""
    rows = texts(docs, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    every = written(examples(rows).withColumn("held", held), "examples")
    counts = {(r["held"], r["label"]) for r in every.select("held", "label").distinct().collect()}
    if not {(False, 0), (False, 1), (True, 1)} <= counts:
        return Model(None, {})
    fit = every.where(~F.col("held")).select(F.col("label").cast("double").alias("y"), array_to_vector("x").alias("features"))
    boosted = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(fit)
    trees = packed(node_table(boosted), F.array(F.col("prediction") * F.col("tree_weight")))
    scored = every.where("held").select("kind", "label", F.floor(probability(trees, F.col("x")) * 100).alias("bin"))
    # at most 101 bins of each kind
    bins = scored.groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count("*").alias("n"))
    above = W.partitionBy("kind").orderBy(F.desc("bin"))
    bins = bins.select("kind", "bin", (F.sum("right").over(above) / F.sum("n").over(above)).alias("precision"))
    lowest = bins.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("bin").alias("bin"))
    return Model(trees, {r["kind"]: r["bin"] / 100 for r in lowest.collect()})


def probability(trees: Column, x: Column) -> Column:
    margin = F.get(tree_sums(trees, x, DEPTH, 1), F.lit(0))
    return 1 / (1 + F.exp(-2 * margin))


def scored(kind: str, model: Model):
    """A function of a match that gives its span and score."""

    def span(m: Column) -> Column:
        score = probability(model.trees, features(kind, m["t"], m["before"], m["after"]))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"))

    return span


def at_least(least: float):
    return lambda s: s["score"] >= least


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base_<kind>..., added): all base spans, and those that the trees select, with scores."""
    rows = with_spans(texts(docs, id_col, text_col))
    judged = [kind for kind in KINDS if model.trees is not None and kind in model.thresholds]
    added = [F.filter(F.transform(f"wider_{kind}", scored(kind, model)), at_least(model.thresholds[kind])) for kind in judged]
    none = F.array().cast("array<struct<kind:int,start:int,end:int,score:double>>")
    return rows.select("doc_id", *[f"base_{kind}" for kind in KINDS], F.concat(*added, none).alias("added"))


def shown(spans: Column) -> Column:
    """Spans (kind, start, end) as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans in order of kind and start."""
    def numbered(k: int):
        return lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))

    base = F.concat(*[F.transform(f"base_{kind}", numbered(k)) for k, kind in enumerate(KINDS)])
    further = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id",
        *[F.size(f"base_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.size("added").cast("long").alias("n_added"),
        base.alias("base"),
        F.sort_array(F.concat(base, further)).alias("every"),
    ).select(
        "doc_id", *[f"n_{kind}" for kind in KINDS], "n_added", F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("every")).alias("spans")
    )
