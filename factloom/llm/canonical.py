"""Problem 7: freely typed values to the entries of a reference list. SQL only.

Every reference entry is spelled in the forms people type it (parts in another order, joined with "of",
parts shortened to a prefix or to consonants). A form of allowed edit distance k is cut into k+1 segments:
a typed string within k edits has at least one of them unchanged, at most k places off. So candidates come
from an equality join on (length of the form, segment number, segment text), are verified with the
built-in levenshtein, and values without a match are reported through an anti-join.

Typed values are aggregated to distinct ones first, and those to distinct letters-and-digits strings, so a value
that fills a third of all rows is matched once. Both tables are materialised, as the later steps read them repeatedly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.runtime import checkpoint

# Words that people put before the name of an entry, with a colon, or after it. Defaults of a parameter.
BEFORE = ("new", "feature")
AFTER = ("module", "modules", "existing")

# Words before and after a name that people add to it, without a bracket or colon to tell them: {before} and {after}
# are lists of SQL literals. Remarks in front, up to a colon, count only if their word is listed.
_KEYS = """
WITH typed_words AS (
  SELECT value,
    filter(split(trim(regexp_replace(lower(regexp_replace(regexp_replace(value, '(?i)^(?:[^a-z0-9]|[0-9]+[.)]\\\\s+|the[^a-z0-9]+|(?:{before})\\\\s*:)+', ''), '([a-z])([A-Z])', '$1 $2')), '[^a-z0-9]+', ' ')), ' '),
      w -> w NOT IN ('', 'of', 'the')) AS words
  FROM {{distinct_values}}),
typed_core AS (
  SELECT value, CASE
      WHEN size(words) > 2 AND get(words, size(words) - 1) IN ({after}) AND get(words, size(words) - 2) IN ({after}) THEN slice(words, 1, size(words) - 2)
      WHEN size(words) > 1 AND get(words, size(words) - 1) IN ({after}) THEN slice(words, 1, size(words) - 1)
      ELSE words END AS words
  FROM typed_words)
SELECT DISTINCT value, typed FROM (
  SELECT value, explode(array(array_join(words, ''), regexp_replace(array_join(words, ''), '({endings})$', ''), regexp_replace(array_join(words, ''), 's$', ''))) AS typed FROM typed_core)
WHERE length(typed) >= 2
"""

# Names of two parts take every mix of shortened parts; longer ones are turned as a whole or shortened in one part.
_FORMS = """
WITH spelled AS (
  SELECT entry_id, filter(split(trim(regexp_replace(lower(spelling), '[^a-z0-9]+', ' ')), ' '), w -> w NOT IN ('', 'of', 'the')) AS words
  FROM (SELECT entry_id, explode(array(name, alias)) AS spelling FROM {entries})
  WHERE spelling IS NOT NULL),
part AS (
  SELECT entry_id, words, size(words) AS n, transform(words, w -> array_distinct(concat(
      array(w, concat(substr(w, 1, 1), regexp_replace(substr(w, 2), '[aeiou]', ''))),
      transform(filter(sequence(3, 9), n -> n < length(w)), n -> substr(w, 1, n)),
      transform(filter(sequence(3, 6), n -> n < length(w)), n -> concat(substr(w, 1, n), 's'))))) AS short
  FROM spelled WHERE size(words) > 0),
forms_all AS (
  SELECT entry_id, 0 AS is_short, explode(transform(sequence(0, n - 1), r -> array_join(concat(slice(words, r + 1, n), slice(words, 1, r)), ''))) AS form FROM part
  UNION ALL
  SELECT entry_id, 0, array_join(reverse(words), '') FROM part WHERE n > 2
  UNION ALL
  SELECT entry_id, 0, concat(get(words, 1), 'of', get(words, 0)) FROM part WHERE n = 2
  UNION ALL
  SELECT entry_id, 1, explode(flatten(transform(get(short, 0), a -> flatten(transform(get(short, 1), b -> array(concat(a, b), concat(b, a))))))) FROM part WHERE n = 2
  UNION ALL
  SELECT entry_id, 1, explode(flatten(transform(sequence(0, n - 1), i -> transform(get(short, i), a -> array_join(transform(words, (w, j) -> CASE WHEN i = j THEN a ELSE w END), ''))))) FROM part WHERE n > 2),
forms AS (
  SELECT entry_id, form, min(is_short) AS is_short, CASE
      WHEN min(is_short) = 1 THEN CASE WHEN length(form) >= 10 THEN 2 WHEN length(form) >= 7 THEN 1 ELSE 0 END
      WHEN length(form) >= 16 THEN 4 WHEN length(form) >= 10 THEN 3 WHEN length(form) >= 6 THEN 2 WHEN length(form) >= 4 THEN 1 ELSE 0 END AS k
  FROM forms_all GROUP BY entry_id, form),
"""


_PROBES = """
segments AS (
  SELECT entry_id, form, is_short, k, length(form) AS len, i,
    substr(form, CAST(floor(i * length(form) / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * length(form) / (k + 1)) AS INT) - CAST(floor(i * length(form) / (k + 1)) AS INT)) AS segment
  FROM forms LATERAL VIEW explode(sequence(0, k)) x AS i),
shapes AS (SELECT DISTINCT len, k FROM segments),
strings AS (SELECT /*+ REPARTITION({tasks}, typed) */ DISTINCT typed FROM {{typed}}),
probes AS (
  SELECT DISTINCT typed, len, k, i,
    substr(typed, at + 1, CAST(floor((i + 1) * len / (k + 1)) AS INT) - CAST(floor(i * len / (k + 1)) AS INT)) AS segment
  FROM (
    SELECT typed, len, k, i, explode(sequence(greatest(CAST(floor(i * len / (k + 1)) AS INT) - k, 0), CAST(floor(i * len / (k + 1)) AS INT) + k)) AS at
    FROM (
      SELECT typed, len, k, explode(sequence(0, k)) AS i
      FROM (SELECT typed, explode(sequence(greatest(length(typed) - 4, 1), length(typed) + 4)) AS len FROM strings) JOIN shapes USING (len)
      WHERE abs(length(typed) - len) <= k))),
pairs AS (
  SELECT DISTINCT p.typed, s.entry_id, s.form, s.is_short, s.k
  FROM probes p JOIN segments s ON p.len = s.len AND p.k = s.k AND p.i = s.i AND p.segment = s.segment),
measured AS (SELECT typed, entry_id, is_short, levenshtein(typed, form, k) AS distance FROM pairs)
SELECT typed, entry_id, min(struct(distance, is_short)) AS rank FROM measured WHERE distance >= 0 GROUP BY typed, entry_id
"""

_BEST = """
WITH best AS (
  SELECT value, min(struct(rank.distance, rank.is_short, entry_id)) AS b FROM {typed} JOIN {matches} USING (typed) GROUP BY value)
SELECT value, b.entry_id AS entry_id, b.distance AS distance FROM best
UNION ALL
SELECT value, CAST(NULL AS INT), CAST(NULL AS INT) FROM {distinct_values} LEFT ANTI JOIN best USING (value)
"""


def map_to_list(values: DataFrame, value: str, entries: DataFrame, entry_id: str, name: str, alias: str, before: tuple[str, ...] = BEFORE, after: tuple[str, ...] = AFTER) -> DataFrame:
    """(value, entry_id, distance): each distinct non-null value with its closest entry, null where none is close enough.

    ``before`` and ``after`` are words that people put before a name (with a colon) or after it, not part of any name.
    A name of two parts may have both shortened, a longer one any one of them; a part is shortened to 3 to 9 letters
    (3 to 6 with a plural s) or to its consonants. Ties go to the smaller distance, then the unshortened form, then the
    smaller entry_id. Empty values and values without letters or digits are unmatched. An exact name has distance 0.
    """
    spark = values.sparkSession
    v = checkpoint(values.selectExpr(f"`{value}` AS value").where("value IS NOT NULL").distinct())
    e = entries.selectExpr(f"`{entry_id}` AS entry_id", f"`{name}` AS name", f"`{alias}` AS alias").where("entry_id IS NOT NULL").distinct()
    none = "(?!)"  # matches nothing
    keys = _KEYS.format(before="|".join(before) or none, after=", ".join(f"'{w}'" for w in after) or "NULL", endings="|".join(after) or none)
    typed = checkpoint(spark.sql(keys, distinct_values=v))
    matches = spark.sql(_FORMS + _PROBES.replace("{tasks}", spark.conf.get("spark.sql.shuffle.partitions")).replace("{{typed}}", "{typed}"), entries=e, typed=typed)
    return spark.sql(_BEST, typed=typed, matches=matches, distinct_values=v)
