"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line, in the order of doc_id and line number, equals it or
is one character insertion, deletion or substitution away. Whether the earlier
line itself stays does not matter, so the result does not depend on the order of work.

1. Equal lines meet by a 128-bit hash; each distinct line keeps its first place.
2. Distinct lines one edit apart share their first or last half: for lengths m <= n of
   the two, common prefix and common suffix have at least m - 1 characters together,
   so one of them has floor(m / 2). Only lines that share such a half, cut down to a
   multiple of four, go on. No pair is lost by this.
3. These emit their deletion neighbourhood as hashed keys: the line itself, and the line
   without the i-th character, for each i in the half that may differ. The key of a text is the
   XOR of a hash of each character with its place, so that the keys of all variants
   follow from running sums, and the work grows in proportion to the line.
4. Equal keys join. Two lines that become equal without their i-th character differ by a
   substitution there; a line that equals another one without a character differs by
   an insertion. So for each key and i only the earliest line matters, which a
   partial aggregation finds: no group is collected and no pairs are listed, however
   many lines share a key.
5. Each found partner is verified on the texts: equal without the character at the place found, or
   the longer one without it equal to the other.

Lines of fewer than ``MIN_CHARS`` characters tell nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Scratch

MIN_CHARS = 20
STEP = 4
#: Characters of a part of a line, and of a piece of a part, over which running sums are taken.
PART, PIECE = 2048, 32
#: Candidate lines up to this number are broadcast (48 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 200_000
_PLACE = ["doc_id", "line_no", "digest"]


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def _halves(line: Column, size: Column) -> Column:
    """Hashes of the first and last parts by which a line of this size can meet others.

    Parts have half the size, down to a multiple of STEP, so that lines one character
    apart mostly have one size of part; where a size is the first of a new multiple, the
    parts of the size before it are added.
    """

    def sides(half: Column) -> list[Column]:
        first, last = F.substring(line, F.lit(1), half), F.substring(line, size - half + 1, half)
        return [F.xxhash64(F.lit("first"), half, first), F.xxhash64(F.lit("last"), half, last)]

    own = (F.floor(size / (2 * STEP)) * STEP).cast("int")
    return F.when(size % (2 * STEP) == 0, F.array(*sides(own), *sides(own - STEP))).otherwise(F.array(*sides(own)))


def _lines(documents: DataFrame) -> DataFrame:
    """A row for each line that is long enough; digest tells texts with one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("size", F.length("line")).where(F.col("size") >= MIN_CHARS)


def removed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, line_no) of each line to remove; digest is the xxhash64 of the text.

    A null text counts as empty, and its one empty line stays. Rows equal in doc_id and
    text are one document and get the same result; a null doc_id comes first in
    the order. Other columns are ignored. Without documents the result is empty.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    line, size = F.col("line"), F.col("size")
    lines = scratch.write(
        _lines(documents.select("doc_id", "text")).select(*_PLACE, "size", *_hashes(line), _halves(line, size).alias("halves")), "lines"
    )
    place = F.struct(*_PLACE)
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("halves").alias("halves"), F.any_value("size").alias("size")
    )
    distinct = scratch.write(distinct, "distinct")
    keyed = distinct.select("h1", "h2", F.posexplode("halves").alias("side", "half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    candidates = keyed.join(shared, "half").groupBy("h1", "h2").agg(
        F.bool_or(F.col("side") % 2 == 0).alias("same_first"), F.bool_or(F.col("side") % 2 == 1).alias("same_last")
    )
    near = _near(documents, scratch.write(candidates, "candidates"), scratch)
    marked = distinct.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    marked = marked.unionByName(near.select("h1", "h2", "first", F.lit(True).alias("near")))
    marked = marked.groupBy("h1", "h2").agg(F.any_value("first").alias("first"), F.bool_or("near").alias("near"))
    marked = scratch.write(marked, "marked")  # read from a table, the join below can split the places of a common line
    hits = lines.select(*_PLACE, "h1", "h2").join(marked, ["h1", "h2"])
    gone = F.col("near") | ~F.struct(*_PLACE).eqNullSafe(F.col("first"))
    return hits.where(gone).select("doc_id", "digest", "line_no")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _variants(found: DataFrame) -> DataFrame:
    """(key, at, number): the key of each line (at -1) and of the line without character `at`.

    With a(k) the hash of character k at its place and b(k) that at the place before,
    the line without character i has the key XOR of a(k) for k < i and of b(k) for k > i. That is
    the XOR of all b, of a(k) and b(k) for all k < i, and of b(i).
    """
    size = F.col("size")
    # without a shared last part, the first floor(m / 2) characters are equal, and the other way round
    begin = F.when(F.col("same_last"), F.lit(0)).otherwise(F.floor((size - 1) / 2).cast("int"))
    end = F.least(F.when(F.col("same_first"), size - 1).otherwise(F.ceil((size + 1) / 2).cast("int")), size - 1)

    def part(text: Column, number: Column) -> Column:
        def sums(chars: Column) -> Column:
            a = F.transform(chars, lambda c, k: F.xxhash64(number * PART + k, c))
            b = F.transform(chars, lambda c, k: F.xxhash64(number * PART + k - 1, c))
            return F.struct(a.alias("a"), b.alias("b"))

        return _let(
            _let(F.split(text, ""), sums),
            lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), _xor(s["a"]).alias("all_a"), _xor(s["b"]).alias("all_b")),
        )

    def sums_of(parts: Column) -> Column:
        """The own key of the line, and of each part its b, its a XOR b, and the XOR of what lies before it with all b."""
        total = F.aggregate(parts, F.lit(0).cast("long"), lambda x, p: x.bitwiseXOR(p["all_b"]))
        own = F.aggregate(parts, F.lit(0).cast("long"), lambda x, p: x.bitwiseXOR(p["all_a"]))

        def placed(total: Column) -> Column:
            def row(p: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(parts, F.lit(1), i), total, lambda x, q: x.bitwiseXOR(q["all_a"]).bitwiseXOR(q["all_b"]))
                both = F.zip_with(p["a"], p["b"], lambda x, y: x.bitwiseXOR(y))
                return F.struct((i * PART).alias("start"), before.alias("before"), both.alias("both"), p["b"].alias("b"), F.when(i == 0, own).alias("own"))

            return F.transform(parts, row)

        return _let(total, placed)

    parts = F.transform(F.regexp_extract_all("line", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), part)
    rows = found.select("number", begin.alias("begin"), end.alias("end"), F.explode(_let(parts, sums_of)).alias("p"))

    def running(both: Column, before: Column) -> Column:
        """For each character the XOR of before with `both` of all earlier characters of the part."""
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / PIECE).cast("int")), lambda q: F.slice(both, q * PIECE + 1, F.lit(PIECE)))

        def scanned(pieces: Column, whole: Column) -> Column:
            def scan(piece: Column, q: Column) -> Column:
                start = F.aggregate(F.slice(whole, F.lit(1), q), before, lambda x, y: x.bitwiseXOR(y))
                sums = F.aggregate(piece, F.array(start), lambda x, y: F.concat(x, F.array(F.element_at(x, -1).bitwiseXOR(y))))
                return F.slice(sums, F.lit(1), F.size(piece))

            return F.flatten(F.transform(pieces, scan))

        return _let(pieces, lambda ps: _let(F.transform(ps, _xor), lambda whole: scanned(ps, whole)))

    p = F.col("p")
    low, high = F.greatest(F.col("begin") - p["start"], F.lit(0)), F.least(F.col("end") - p["start"], F.size(p["b"]) - 1)
    keys = F.zip_with(running(p["both"], p["before"]), p["b"], lambda x, y: x.bitwiseXOR(y))
    keys = F.transform(keys, lambda key, k: F.struct(key.alias("key"), (p["start"] + k).alias("at")))
    none = F.array().cast("array<struct<key:bigint,at:int>>")
    without = F.when(high >= low, F.slice(keys, low + 1, high - low + 1)).otherwise(none)
    whole = F.when(p["own"].isNull(), none).otherwise(F.array(F.struct(p["own"].alias("key"), F.lit(-1).alias("at"))))
    return rows.select("number", F.explode(F.concat(whole, without)).alias("v")).select("v.key", "v.at", "number")


def _near(documents: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """h1, h2 and first of the distinct lines that have an earlier line one edit away."""
    wanted = common.broadcast_if_small(candidates, BROADCAST_LINES)
    rows = _lines(documents).select(*_PLACE, "line", "size", *_hashes(F.col("line"))).join(wanted, ["h1", "h2"])
    found = rows.groupBy("h1", "h2", "size", "same_first", "same_last").agg(F.min(F.struct(*_PLACE)).alias("first"), F.any_value("line").alias("line"))
    found = scratch.write(found.withColumn("number", F.monotonically_increasing_id()), "candidate_lines")

    emitted = scratch.write(_variants(found), "emitted")  # once: making keys costs more than reading them
    shared = emitted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    lines = found.select("number", F.struct("first", "h1", "h2").alias("line"))
    variants = scratch.write(emitted.join(shared, "key").join(lines, "number").select("key", "at", "line"), "variants")
    scratch.drop("emitted")

    # of each key: the earliest line for each deleted place, the line that is the key, the earliest of all shorter by one
    by_place = variants.groupBy("key", "at").agg(F.min("line").alias("earliest"), F.count("*").alias("n"))
    by_key = by_place.groupBy("key").agg(
        F.max(F.when(F.col("at") < 0, F.col("earliest"))).alias("itself"),
        F.min(F.when(F.col("at") >= 0, F.struct("earliest", "at"))).alias("shortened"),
    )
    same_place = variants.join(by_place.where("n > 1 AND at >= 0").drop("n"), ["key", "at"])
    partners = same_place.select("line", F.col("earliest").alias("partner"), "at")
    met = variants.join(by_key.where("itself IS NOT NULL AND shortened IS NOT NULL"), "key")
    is_key = F.col("at") < 0
    partners = partners.unionByName(met.select(
        "line", F.when(is_key, F.col("shortened.earliest")).otherwise(F.col("itself")).alias("partner"), F.when(is_key, F.col("shortened.at")).otherwise(F.col("at")).alias("at")
    ))
    partners = partners.where(F.col("partner")["first"] < F.col("line")["first"]).groupBy("line", "partner").agg(F.min("at").alias("at"))
    texts = found.select("h1", "h2", "line", "size")
    pairs = partners.select(
        *(F.col("line")[c].alias(c) for c in ("h1", "h2", "first")), F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2"), "at"
    )
    others = texts.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("other"), F.col("size").alias("other_size"))
    pairs = pairs.join(texts, ["h1", "h2"]).join(others, ["p1", "p2"])

    def without(text: str) -> Column:
        return F.concat(F.substring(text, F.lit(1), F.col("at")), F.substring(text, F.col("at") + 2, F.length(text)))

    # equal without the character at the place, or the longer one is the other without it
    grown = F.col("size") - F.col("other_size")
    verified = F.when(grown == 0, without("line") == without("other")).when(grown == 1, without("line") == F.col("other"))
    verified = verified.when(grown == -1, F.col("line") == without("other")).otherwise(F.lit(False))
    return pairs.where(verified).select("h1", "h2", "first").distinct()


def deduplicate(documents: DataFrame) -> DataFrame:
    """Each row with its text without the removed lines, and n_lines and removed (line numbers).

    Rows, repeated ones too, and other columns pass through; columns named like added
    ones are replaced. A null text stays null and has 0 lines. A text that loses all
    its lines becomes empty.
    """
    gone = removed_lines(documents).distinct().groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("line_no")).alias("_removed"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "_removed")
    out = [c for c in documents.columns if c not in ("n_lines", "removed")]
    rows = documents.select(*out).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_digest")), "left"
    )
    cut = F.split("text", "\n", -1)
    # cut once: within a lambda function an expression is computed again for each element
    kept = _let(cut, lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_removed")), lambda i: parts[i]), "\n"))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)
    removed = F.coalesce(F.col("_removed"), F.array().cast("array<int>"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(cut)).cast("long")
    return rows.select(*(text.alias("text") if c == "text" else F.col(c) for c in out), lines.alias("n_lines"), removed.alias("removed"))


def kept_documents(documents: DataFrame) -> DataFrame:
    """deduplicate() with the columns of documents only; n_chars, if there, follows the text.

    Rows that have lost lines and hold no word any more go; all others stay.
    """
    columns = documents.columns
    clash = {c: f"_own_{c}" for c in columns if c in ("n_lines", "removed")}
    rows = deduplicate(documents.withColumnsRenamed(clash))
    rows = rows.where((F.size("removed") == 0) | F.coalesce(F.col("text").rlike(common.WORD), F.lit(False)))
    length = F.when(F.size("removed") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in columns else None
    return rows.select(*(length.alias(c) if c == "n_chars" else F.col(clash.get(c, c)).alias(c) for c in columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE = f"""
WITH numbered AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM numbered),
long_lines AS (SELECT * FROM placed WHERE length(line) >= {MIN_CHARS}),
firsts AS (SELECT line, length(line) AS size, min(struct_pack(d := doc_id, n := line_no)) AS first FROM long_lines GROUP BY line),
near AS (
  SELECT DISTINCT a.line FROM firsts a JOIN firsts b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND b.first < a.first
    AND (substr(a.line, 1, (least(a.size, b.size) // 2)::INT) = substr(b.line, 1, (least(a.size, b.size) // 2)::INT)
      OR right(a.line, (least(a.size, b.size) // 2)::INT) = right(b.line, (least(a.size, b.size) // 2)::INT))
    AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT doc_id, line_no FROM long_lines JOIN firsts USING (line)
  WHERE first <> struct_pack(d := doc_id, n := line_no) OR line IN (SELECT line FROM near)),
listed AS (SELECT doc_id, list(line_no ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(removed), 0) AS n_removed,
  coalesce(removed, []) AS removed,
  sha256(CASE WHEN removed IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(removed, i)), lambda i: lines[i + 1]), chr(10)) END) AS text_sha256
FROM numbered n LEFT JOIN listed USING (doc_id)
"""

QUERIES = {"op10_line_dedup": op10}
ORACLES = {"op10_line_dedup": ORACLE}
