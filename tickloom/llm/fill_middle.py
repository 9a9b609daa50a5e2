"""Fill-in-middle transformation by escaped marker injection, in string functions alone.

A delimiter is escaped in the text, regexp_replace puts it after each unit, its count is the number of units, substring_index cuts the
parts at the ranks that were drawn, and the parts are unescaped and put together. There is no shuffle and no array of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle in the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many have their suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42

#: The delimiter and what escapes it. Neither is white space, so escaping changes no unit's bounds.
_END, _ESC = "\u0001", "\u0002"


def escaped(text: Column) -> Column:
    """text without any delimiter, from which unescaped() gets it back."""
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_END), F.lit(_ESC + "d"))


def unescaped(part: Column) -> Column:
    """What escaped() was given, delimiters between units left out. No escape sequence spans two units."""
    plain = F.replace(part, F.lit(_END), F.lit(""))
    return F.replace(F.replace(plain, F.lit(_ESC + "d"), F.lit(_END)), F.lit(_ESC + "e"), F.lit(_ESC))


def _ranked(count: Column) -> Column:
    """The first `count` units of _marked, or the last ones behind the delimiter of that rank from the end, with delimiters between them."""
    return F.call_function("substring_index", F.col("_marked"), F.lit(_END), count.cast("int"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every row of docs.

    n is the number of units. form is plain (output is the text, the parts are null), psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    Cuts and form are drawn from a SHA-256 of seed and id, so reruns agree. A null text is empty. Empty texts and texts that hold a mark are
    plain. A row without an id is drawn by its text's SHA-256; rows that repeat an id share their draws; an empty table gives an empty result.
    Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    who = F.coalesce(F.col("doc_id").cast("string"), F.sha2("text", 256))
    rows = rows.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}:"), who), 256)).withColumn("_escaped", escaped(F.col("text")))
    rows = rows.withColumn("_marked", F.regexp_replace("_escaped", UNIT, "$0" + _END)).withColumn("n", (F.length("_marked") - F.length("_escaped")).cast("long"))
    draw = lambda k: F.conv(F.substring("_draw", 8 * k + 1, 8), 16, 10).cast("long")
    one, two = F.pmod(draw(0), F.col("n") + 1), F.pmod(draw(1), F.col("n") + 1)
    marks = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marks | (draw(2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(3) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "_marked", "n", form.alias("form"), F.least(one, two).alias("_after"), F.greatest(one, two).alias("_to"))
    cut = F.col("form") != "plain"
    # The middle is what is left of the first _to units behind the first _after of them.
    rows = rows.select("doc_id", "text", "n", "form", "_after", "_to", *[F.when(cut, _ranked(c)).alias(name) for name, c in (("_p", F.col("_after")), ("_h", F.col("_to")), ("_s", F.col("_to") - F.col("n") - 1))])
    middle = F.expr("substring(_h, length(_p) + 1)")
    rows = rows.select("doc_id", "text", "n", "form", unescaped(F.col("_p")).alias("prefix"), unescaped(middle).alias("middle"), unescaped(F.col("_s")).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks stand once in an output that isn't plain, and none can arise where two parts meet."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return out.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS s FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
