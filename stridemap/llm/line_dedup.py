"""Line dedup with a log-template tree. DataFrame functions only.

A text's lines are cut at line feeds, a line's tokens at [\\x20\\x09-\\x0D]; a token with a digit is the
wildcard <*>. The tree has a fixed depth: a line's leaf is its number of tokens and its first
`leading` tokens. Within a leaf a token is constant at its place if at least `least` lines have it there; other places are
variable fields, generalised to the wildcard. What remains is the line's template.

A line without a variable field recurs if two or more documents have it (its own tokens, before any is masked). A template with fields
recurs if at least `least` lines of two or more documents have it (equal lines of a document count once), and if it
says enough: lines that differ in wildcards only, or at least `least_constant` tokens and `constant_percent` percent of all
constant. Recurring lines and lines of recurring templates are dropped, wherever they are.

Lines become 64-bit hashes, of leaf, masked tokens, tokens and raw line, in a written table, and are counted by them; only lines of leaves
that could hold a template with fields are fetched again and taken apart, once for each distinct line, so a
line that is in every document is one row from there on. Small sides (where to fetch, and the
dropped lines) are broadcast up to a quarter of and up to `broadcast_rows` rows, and joined by a shuffle beyond. The places of
dropped lines in a text come from an equality join on (id, text, line), and what is left of a text from array_except over places, which hashes:
the work within a document is in proportion to its lines.

Cases: null and empty texts have one empty line; lines without tokens are kept and count for nothing; repeated rows (same id)
are one document; documents without an id count as lines of no document, and lose recurring lines as others do; an
empty table gives no rows. Other columns, of any name, are passed through where texts are returned; columns named n_lines
or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap.session import discard, materialize

GAP = "[\\x20\\x09-\\x0D]+"
WILD = "<*>"


def raw_tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, GAP), "")


def mask(tokens: Column) -> Column:
    """Tokens with a digit as wildcards."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILD)).otherwise(t))


def line_tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit as wildcards."""
    return F.when(line.rlike("[0-9]"), mask(raw_tokens(line))).otherwise(raw_tokens(line))


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def document_lines(docs: DataFrame, id_col: str, text_col: str, leading: int) -> DataFrame:
    """(id, mark, raw, own, leaf, n_tokens, key) for the different lines with tokens of each row: hashes of the row's text, the
    line, its tokens, its leaf and its masked tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    lines = lines.select("id", "mark", F.xxhash64("line").alias("raw"), raw_tokens(F.col("line")).alias("own"), F.col("line").rlike("[0-9]").alias("masks")).where(F.size("own") > 0)
    tokens = F.when(F.col("masks"), mask(F.col("own"))).otherwise(F.col("own"))
    lines = lines.select("id", "mark", "raw", F.xxhash64("own").alias("own"), tokens.alias("tokens"))
    return lines.select("id", "mark", "raw", "own", leaf_of(F.col("tokens"), leading).alias("leaf"), F.size("tokens").alias("n_tokens"), F.xxhash64("tokens").alias("key"))


def leaf_of(tokens: Column, leading: int) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, leading))


def recurring_lines(lines: DataFrame, docs: DataFrame, text_col: str, leading: int, least: int, least_constant: int, constant_percent: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(own) and (key) of the lines to drop: hashes of their tokens and masked tokens. lines: what document_lines() gives for docs."""
    counts = [F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")]
    kinds = materialize(lines.groupBy("leaf", "n_tokens", "key", "own").agg(*counts, F.min_by("mark", "raw").alias("mark"), F.min("raw").alias("raw")), "kinds")
    same = materialize(kinds.where(F.col("lo") < F.col("hi")).select("own").distinct(), "same")
    whole = kinds.groupBy("leaf", "n_tokens", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("mark", "raw").alias("mark"), F.min("raw").alias("raw"))
    whole = materialize(whole, "whole")
    exact = whole.where((F.col("n") >= least) & (F.col("lo") < F.col("hi"))).select("key")
    leaves = whole.where(F.col("n_tokens") >= least_constant).groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = leaves.where((F.col("n") >= least) & (F.col("kinds") > 1) & (F.col("lo") < F.col("hi"))).select("leaf")
    some = materialize(whole.where(F.col("n_tokens") >= least_constant).join(leaves, "leaf", "left_semi"), "some")
    # the tokens of those lines, each fetched from one text that has it
    wanted = materialize(some.select("mark", "raw").distinct(), "wanted")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    near = _near(wanted, broadcast_rows // 4)
    marked = docs.select(text.alias("text"), F.xxhash64(text).alias("mark"))
    texts = marked.join(near.select("mark").distinct(), "mark", "left_semi")
    found = texts.select("mark", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).withColumn("raw", F.xxhash64("line")).join(near, ["mark", "raw"], "left_semi")
    found = found.select(line_tokens(F.col("line")).alias("tokens")).select("tokens", leaf_of(F.col("tokens"), leading).alias("leaf"), F.xxhash64("tokens").alias("key"))
    apart = materialize(found.groupBy("leaf", "key", "tokens").agg(F.lit(1).alias("one")).drop("one").join(some.select("leaf", "key", "n", "lo", "hi"), ["leaf", "key"]), "apart")
    fields = apart.select("leaf", "key", "n", F.posexplode("tokens").alias("place", "token"))
    constant = fields.groupBy("leaf", "place", "token").agg(F.sum("n").alias("of")).where(F.col("of") >= least).select("leaf", "place", "token")
    mark = F.xxhash64("place", "token")
    shapes = fields.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "key").agg(F.bit_xor(mark).alias("shape"), F.count("*").alias("n_constant"))
    shaped = apart.select("leaf", "key", "n", "lo", "hi", F.size("tokens").alias("n_tokens")).join(shapes, ["leaf", "key"])
    enough = (F.col("n_constant") >= least_constant) & (100 * F.col("n_constant") >= constant_percent * F.col("n_tokens"))
    shaped = materialize(shaped.where(enough), "shapes")
    templates = shaped.groupBy("leaf", "shape", "n_constant").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    templates = templates.where((F.col("n") >= least) & (F.col("lo") < F.col("hi"))).select("leaf", "shape", "n_constant")
    loose = shaped.join(templates, ["leaf", "shape", "n_constant"]).select("key")
    out = materialize(exact.unionByName(loose).distinct(), "dropped")
    discard(kinds, whole, some, wanted, apart, shaped)
    return same, out


def drop_recurring_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    leading: int = 3,
    least: int = 5,
    least_constant: int = 6,
    constant_percent: int = 75,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """The documents with the recurring lines taken out of text_col (all other columns as they are),
    and n_lines and n_dropped."""
    lines = materialize(document_lines(docs, id_col, text_col, leading), "lines")
    same, dropped = recurring_lines(lines, docs, text_col, leading, least, least_constant, constant_percent, broadcast_rows)
    gone = lines.join(_near(same, broadcast_rows), "own", "left_semi").select("id", "mark", "raw")
    gone = materialize(gone.unionByName(lines.join(_near(dropped, broadcast_rows), "key", "left_semi").select("id", "mark", "raw")).distinct(), "gone")
    # rows of one id and text are alike, so this pair is a key; null ids are one key
    key = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.col("id").isNull().alias("unnamed"), "mark"]
    on = ["name", "unnamed", "mark"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # the columns of documents lie in a struct, so that no name clashes
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.split(text, "\n").alias("parts"))
    rows = rows.select("row", *key, "parts")
    at = rows.select(*on, F.posexplode("parts").alias("place", "line")).select(*on, "place", F.xxhash64("line").alias("raw"))
    places = at.join(_near(gone.select(*key, "raw"), broadcast_rows), [*on, "raw"], "left_semi").groupBy(*on).agg(F.collect_set("place").alias("places"))
    joined = rows.join(_near(materialize(places, "places"), broadcast_rows // 4), on, "left")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("places")), lambda k: F.get("parts", k))
    own = F.col("row")[text_col]
    shorter = F.when(F.col("places").isNull(), own.cast("string")).otherwise(F.array_join(rest, "\n"))
    return joined.select(
        *(shorter.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept),
        F.size("parts").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


#: The same in DuckDB SQL, over documents; without hashes.
ORACLE = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
), placed AS (
  SELECT doc_id, unnest(raw) AS line, generate_subscripts(raw, 1) AS place FROM parts
), cut AS (
  SELECT doc_id, place, line,
    list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS own,
    list_transform(own, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM placed
), same AS (
  SELECT own FROM cut WHERE len(own) > 0 GROUP BY own HAVING min(doc_id) < max(doc_id)
), whole AS (
  SELECT tokens, len(tokens) AS size, list_slice(tokens, 1, 3) AS lead, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi
  FROM (SELECT DISTINCT doc_id, line, tokens FROM cut WHERE len(tokens) > 0) GROUP BY tokens
), fields AS (
  SELECT tokens, size, lead, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM whole
), constant AS (
  SELECT size, lead, place, token FROM fields GROUP BY ALL HAVING sum(n) >= 5
), shapes AS (
  SELECT f.tokens, list((f.place, f.token) ORDER BY f.place) AS shape, count(*) AS n_constant
  FROM fields f JOIN constant c USING (size, lead, place, token) GROUP BY f.tokens
), shaped AS (
  SELECT w.tokens, w.size, w.lead, w.n, w.lo, w.hi, s.shape, s.n_constant FROM whole w JOIN shapes s USING (tokens)
  WHERE s.n_constant = w.size OR (s.n_constant >= 6 AND 100 * s.n_constant >= 75 * w.size)
), templates AS (
  SELECT size, lead, shape FROM shaped GROUP BY ALL HAVING sum(n) >= 5 AND min(lo) < max(hi)
), dropped AS (
  SELECT s.tokens FROM shaped s JOIN templates t USING (size, lead, shape)
)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (tokens IN (SELECT tokens FROM dropped) OR own IN (SELECT own FROM same)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (tokens NOT IN (SELECT tokens FROM dropped) AND own NOT IN (SELECT own FROM same)), '')) AS kept_sha256
FROM cut GROUP BY doc_id
"""
