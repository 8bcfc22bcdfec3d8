"""Line deduplication with a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as sequences of words. A line is dropped if an earlier one (by doc_id, then position) has the same
words, or, for lines of MIN_WORDS words or more, if an earlier one is within one word insertion, deletion or
substitution. Every line that may have such a neighbour emits its deletion variants as hashed keys: with the deleted
position, to meet lines of the same length that have another word there, and as a shorter line, to meet the whole of
a line that lacks the word. Per key only the earliest line is kept to compare with, so that a key which many
lines share gives one pair per line; each pair is verified by its common prefix and suffix.

Which lines may have a neighbour is decided exactly and cheaply beforehand: two lines within one edit share their
first or their last half, so lines whose halves occur once emit nothing more, and others only the keys that can meet a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.llm.common import WORD, materialize, table

#: One word of fewer would be too large a part of the line.
MIN_WORDS = 8
#: Found in lines that have a word. Anchors wouldn't do: Java's $ also matches before a last line separator.
FILLED = "[^\\x20\\x09-\\x0D]"
#: Up to so many lines are broadcast to filter the documents; above, they are joined by shuffle. A line is numbers only,
#: of about 100 bytes (two keys, its place and id, three flags), so this is 50 MB at most.
BROADCAST_ROWS = 500_000
#: Texts of at most so many lines are put together by looking up each line.
FEW = 500


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def half_keys(words: Column, w: Column) -> Column:
    """Hashes of the first and last half of the line as it is (longer 0), and as a line with one word too many (longer 1)."""
    keys = []
    for n in (w, w - 1):
        h = F.floor(n / 2).cast("int")
        keys += [F.xxhash64(F.lit("p"), n, F.slice(words, 1, h)), F.xxhash64(F.lit("s"), n, F.slice(words, w - n + h + 1, n - h))]
    return F.array(*keys)


def chain(hashes: Column) -> Column:
    """Hashes of the first 0, 1, 2 and so on of hashes."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), x))))


def variants(words: Column, w: Column, whole: Column, longer: Column, same: Column) -> Column:
    """Keys of a line: role 0 the whole, split at any place; 1 a word deleted; 2 a word deleted from a line of this length.

    A key is made of the length that is left, the place, and the hashes of what stands before and after it. whole,
    longer and same say which roles can meet another line.
    """
    hashes = F.transform(words, lambda x: F.xxhash64(x))

    def all_keys(parts: Column) -> Column:
        before, after = lambda i: F.get(parts["before"], i), lambda i: F.get(parts["after"], i)
        places = F.sequence(F.lit(0), w - 1)
        key = lambda k, role: F.struct(k.alias("key"), F.lit(role).alias("role"))
        none = F.array().cast("array<struct<key:bigint,role:int>>")
        return F.concat(
            F.when(whole, F.transform(F.sequence(F.lit(0), w), lambda i: key(F.xxhash64(F.lit("d"), w, i, before(i), after(w - i)), 0))).otherwise(none),
            F.when(longer, F.transform(places, lambda i: key(F.xxhash64(F.lit("d"), w - 1, i, before(i), after(w - i - 1)), 1))).otherwise(none),
            F.when(same, F.transform(places, lambda i: key(F.xxhash64(F.lit("r"), w, i, before(i), after(w - i - 1)), 2))).otherwise(none),
        )

    parts = F.struct(chain(hashes).alias("before"), chain(F.reverse(hashes)).alias("after"))
    return F.element_at(F.transform(F.array(parts), all_keys), 1)


def common_prefix(a: Column, b: Column) -> Column:
    mismatch = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(mismatch == 0, F.size(a)).otherwise(mismatch - 1)


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_key, rid, keep (array of positions): the lines with words that stay, for docs (doc_id, text).

    rid is a hash of doc_id and text; rows that agree in both are one document here.
    """
    rows = keyed(docs)
    lines = rows.select("doc_key", "rid", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(FILLED))  # not by w: words would be found twice
    lines = lines.withColumn("words", words_of(F.col("line"))).withColumn("w", F.size("words"))
    lines = lines.select("doc_key", "pos", "rid", "w", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("2"), "words").alias("h2"), F.when(F.col("w") >= MIN_WORDS, half_keys(F.col("words"), F.col("w"))).alias("halves"))
    distinct = lines.groupBy("h1", "h2", "w").agg(F.min(F.struct("doc_key", "pos", "rid")).alias("first"), F.any_value("halves").alias("halves"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("line_id"), "w", "first", "halves"), "lines")

    halves = distinct.where(F.col("halves").isNotNull()).select("line_id", F.posexplode("halves").alias("i", "key")).select("line_id", "key", (F.col("i") >= 2).alias("longer"))
    # in a bucket stand lines of one length and lines that are one word longer
    met = halves.groupBy("key").agg(F.count_if(~F.col("longer")).alias("n0"), F.count_if("longer").alias("n1")).where("n0 > 1 OR n0 > 0 AND n1 > 0")
    roles = (
        halves.join(met, "key")
        .where("NOT longer OR n0 > 0")
        .groupBy("line_id")
        .agg(F.max(~F.col("longer") & (F.col("n1") > 0)).alias("whole"), F.max("longer").alias("longer"), F.max(~F.col("longer") & (F.col("n0") > 1)).alias("same"))
        .where("whole OR longer OR same")
    )
    maybe = materialize(distinct.drop("halves").join(roles, "line_id"), "maybe")
    near = near_lines(rows, maybe)

    firsts = distinct.select("line_id", "first.*").join(near, "line_id", "left_anti")
    return firsts.groupBy("doc_key", "rid").agg(F.collect_list("pos").alias("keep"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_key (null ids last) and rid."""
    return docs.withColumn("doc_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(9223372036854775807))).withColumn("rid", F.xxhash64("doc_id", "text"))


def near_lines(rows: DataFrame, maybe: DataFrame) -> DataFrame:
    """line_id of the lines in maybe (line_id, first, and the roles they can have) that have an earlier line within one edit."""
    wanted = maybe.select("line_id", "first.*", "whole", "longer", "same").groupBy("doc_key", "rid").agg(F.collect_list(F.struct("pos", "line_id", "whole", "longer", "same")).alias("wanted"))
    wanted = F.broadcast(wanted) if maybe.count() <= BROADCAST_ROWS else wanted
    found = rows.select("doc_key", "rid", "text").join(wanted, ["doc_key", "rid"]).withColumn("lines", F.split("text", "\n"))
    found = found.select("doc_key", F.explode("wanted").alias("x"), "lines").select("doc_key", "x.*", F.get("lines", F.col("x.pos")).alias("line"))
    found = materialize(found.dropDuplicates(["line_id"]).withColumn("words", words_of(F.col("line"))).drop("line").withColumn("w", F.size("words")), "words")

    me = F.struct("doc_key", "pos", "line_id")
    keys = materialize(found.select(me.alias("me"), F.explode(variants(*map(F.col, ("words", "w", "whole", "longer", "same")))).alias("v")).select("me", "v.*"), "variants")  # read twice below
    earliest = (
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), *[F.min(F.when(F.col("role") == r, F.col("me"))).alias(f"e{r}") for r in (0, 1, 2)])
        .where("n > 1")
    )
    # the whole line looks for the earliest that has a word more, a line with a word more for the whole one
    other = F.when(F.col("role") == 2, F.col("e2")).when(F.col("role") == 1, F.col("e0")).otherwise(F.col("e1"))
    pairs = keys.join(earliest, "key").withColumn("other", other).where("other < me").select(F.col("me.line_id").alias("line_id"), F.col("other.line_id").alias("other_id")).distinct()
    a, b = found.select("line_id", F.col("words").alias("a")), found.select(F.col("line_id").alias("other_id"), F.col("words").alias("b"))
    both = pairs.join(a, "line_id").join(b, "other_id")
    longer = F.greatest(F.size("a"), F.size("b"))
    agree = common_prefix(F.col("a"), F.col("b")) + common_prefix(F.reverse("a"), F.reverse("b"))
    return both.where(agree >= longer - 1).select("line_id").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (with doc_id, text and any other columns) with the deduplicated text and n_lines, n_kept (lines with words, before and after).

    Lines end at \\n; lines without words always stay, and so does the order. Null text stays null with no lines. Rows
    without doc_id come after all others. Of equal lines in one document the first stays. Rows that agree in doc_id and
    text are treated alike. An empty table gives an empty table. Other columns may have any names; ones called n_lines or
    n_kept, in whatever case, are replaced by those made here.
    """
    # the other columns travel in one struct, so that no name of theirs matters here
    others = [c for c in docs.columns if c not in ("doc_id", "text") and c.lower() not in ("n_lines", "n_kept")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    keep = kept_lines(packed.select("doc_id", "text"))
    rows = keyed(packed).join(keep, ["doc_key", "rid"], "left").withColumn("keep", F.coalesce("keep", F.array().cast("array<int>")))

    def rebuilt(lines: Column) -> Column:
        blank = lambda x: ~x.rlike(FILLED)
        few = F.array_join(F.transform(lines, lambda x, i: F.when(blank(x) | F.array_contains("keep", i), x)), "\n")
        # with many lines, looking each up among the kept ones would take the square of their number
        blanks = F.filter(F.transform(lines, lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
        many = F.array_join(F.transform(F.array_sort(F.concat("keep", blanks)), lambda i: F.get(lines, i)), "\n")
        counted = F.size(F.filter(lines, lambda x: ~blank(x))).cast("bigint")
        return F.struct(F.when(F.size(lines) <= FEW, few).otherwise(many).alias("text"), counted.alias("n_lines"))

    made = F.when(F.col("text").isNotNull(), F.element_at(F.transform(F.array(F.split("text", "\n")), rebuilt), 1))
    out = rows.withColumn("made", made).withColumn("text", F.col("made.text"))
    back = [F.col(c) if c in ("doc_id", "text") else F.col(f"others.`{c}`").alias(c) for c in docs.columns if c in ("doc_id", "text", *others)]
    return out.select(*back, F.coalesce("made.n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.size("keep").cast("bigint").alias("n_kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with each line at its earliest place only."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
k AS (SELECT *, array_to_string(words, ' ') AS key, len(words) AS w FROM l),
f AS (SELECT key, any_value(words) AS words, any_value(w) AS w, min((coalesce(doc_id, 9223372036854775807), pos)) AS ord FROM k WHERE w > 0 GROUP BY key),
v AS (SELECT key, w, ord, i, array_to_string(words[1:i - 1], ' ') AS a, array_to_string(words[i + 1:], ' ') AS b
      FROM (SELECT *, unnest(range(1, w + 1)) AS i FROM f WHERE w >= 8)),
near AS (
  SELECT x.key FROM v x JOIN v y ON x.w = y.w AND x.i = y.i AND x.a = y.a AND x.b = y.b AND y.ord < x.ord
  UNION SELECT x.key FROM v x JOIN f y ON trim(x.a || ' ' || x.b) = y.key AND y.w >= 8 AND y.ord < x.ord
  UNION SELECT y.key FROM v x JOIN f y ON trim(x.a || ' ' || x.b) = y.key AND y.w >= 8 AND x.ord < y.ord),
s AS (SELECT k.doc_id, k.pos, k.line, k.w, k.w = 0 OR ((coalesce(k.doc_id, 9223372036854775807), k.pos) = f.ord AND near.key IS NULL) AS stays
      FROM k LEFT JOIN f ON k.key = f.key LEFT JOIN near ON k.key = near.key)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') END AS text,
       count(*) FILTER (WHERE w > 0) AS n_lines, count(*) FILTER (WHERE w > 0 AND stays) AS n_kept
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id, d.text
"""
