"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived (see ``trigrams``). The index holds, for the
trigrams of the queries, the rows whose texts contain them; rows are numbered in a written table, so that no two share a key,
however many copies of a text there are. The queries' trigrams meet the postings in a join with the (fixed, small) table of
queries; a text that has all trigrams of an alternative is a candidate of the rule, and only
candidates are searched with the rule's pattern. Rules without a mandatory trigram search every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_of, numbered, quoted, stage
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern (the same in Java and Python), and the fewest characters of a group.

    ``search`` may give another pattern with the same matches of that length, found faster.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    search: str | None = None


#: The base rules, in order.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
#: Public token formats that are searched besides.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    # with its body, which may have headers with a few hyphens, where its end is there
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,16}-----END [A-Z ]*PRIVATE KEY-----)?"),
)
RULES = BASE + FURTHER


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Places of the leftmost non-overlapping matches: what lies between them is what splitting leaves.

    Lengths are added up in runs of about the root of their number, so that the work grows little faster than the matches.
    """
    pattern = rule.search or rule.pattern
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.char_length) if rule.group else lengths
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def walked(run: Column) -> Column:
        """The run's length and its matches, placed from the run's start."""
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(x["long"], F.lit(0))).alias("at"),
                F.when(x["kept"] >= rule.least, F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["long"]).alias("end"))))).otherwise(acc["found"]).alias("found"),
            ),
        )

    def placed(runs: Column) -> Column:
        starts = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        )["starts"]
        return F.flatten(F.zip_with(runs, starts, lambda r, at: F.transform(r["found"], lambda s: F.struct((s["start"] + at).alias("start"), F.lit(number).alias("rule"), (s["end"] + at).alias("end")))))

    def found(each: Column) -> Column:
        long = F.ceil(F.sqrt(F.size(each))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / long).cast("int")), lambda i: walked(F.slice(each, i * long + 1, long)))
        return _let(runs, placed)

    return _let(F.arrays_zip(gaps.alias("gap"), lengths.alias("long"), kept.alias("kept")), found)


_NONE = "cast(array() as array<struct<start:int,rule:int,end:int>>)"


def searched(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its columns numbered (``c0``, ...), the text as ``body``, and ``spans``: sorted structs (start, rule, end) in code points."""
    queries = [trigram_query(r.pattern) for r in rules]
    terms = [(n, a, t, len(q)) for n, found in enumerate(queries) for a, q in enumerate(found or ()) for t in sorted(q)]
    body = F.coalesce(F.col(number_of(docs, text_col)).cast("string"), F.lit(""))
    keyed = numbered(docs)
    if terms:
        grams = sorted({t for _, _, t, _ in terms})
        held = _let(F.lower(body), lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(t)), F.lit(i).cast("short")) for i, t in enumerate(grams)])))
        wanted = docs.sparkSession.createDataFrame([(n, a, grams.index(t), size) for n, a, t, size in terms], "rule int, alternative int, gram short, size int")
        # the rows and the trigrams that each holds, written before the trigrams are inverted
        forward = stage(keyed.select("*", F.monotonically_increasing_id().alias("row"), held.alias("held")), "forward_index")
        postings = forward.select("row", F.explode("held").alias("gram"))
        met = postings.join(F.broadcast(wanted), "gram").groupBy("row", "rule", "alternative", "size").count().where(F.col("count") == F.col("size"))
        candidates = met.groupBy("row").agg(F.collect_set("rule").alias("rules"))
        keyed = forward.drop("held").join(candidates, "row", "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(None).cast("array<int>"))
    keyed = keyed.withColumn("body", body)
    # a rule's spans only where it is a candidate; concat of the kinds, sorted by start, then kind
    parts = [_spans(F.col("body"), r, n) if queries[n] is None else F.when(F.array_contains("rules", n), _spans(F.col("body"), r, n)).otherwise(F.expr(_NONE)) for n, r in enumerate(rules)]
    return keyed.withColumn("spans", F.array_sort(F.concat(*parts)))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rule"] + 1), s["start"], s["end"])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", further: tuple[Rule, ...] = FURTHER) -> DataFrame:
    """One row a document: numbers of base findings, a digest of them, and all spans.

    Null and empty texts have no findings (the digest is that of the empty string). Rows repeat
    as given; other columns are left out.
    """
    rules = BASE + further
    found = searched(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "text", rules)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("long")

    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return found.select(F.col("c0").alias(id_col), *counts, F.sha2(_written(base, rules), 256).alias("base_sha256"), _written(F.col("spans"), rules).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns and rows of ``docs`` with each secret in the text replaced by ``mark``.

    Overlapping spans become one mark. ``chars_col``, if given, becomes the new length of a changed text.
    Texts without secrets, null ones among them, stay as they are, and so do all other columns, whatever their names.
    """
    found = searched(docs, text_col, rules)
    body = F.col("body")
    # from the end of one mark's span to the start of the next
    state = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("clear")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["clear"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))))).otherwise(acc["clear"]).alias("clear"),
        ),
    )
    rest = lambda x: F.array(F.struct(x["at"].alias("start"), F.char_length(body).alias("end")))
    clean = _let(state, lambda x: F.array_join(F.transform(F.concat(x["clear"], rest(x)), lambda c: F.substring(body, c["start"] + 1, c["end"] - c["start"])), mark))
    hit = F.size("spans") > 0
    out = []
    for i, field in enumerate(docs.schema):
        own = F.col(f"c{i}")
        if field.name.lower() == text_col.lower():
            own = F.when(hit, clean).otherwise(own)
        elif chars_col and field.name.lower() == chars_col.lower():
            own = F.when(hit, F.char_length(clean)).otherwise(own).cast(field.dataType)
        out.append(own.alias(f"c{i}"))
    return found.select(*out).toDF(*docs.columns)
