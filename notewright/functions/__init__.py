"""Functions for SQL, registered on a session."""

from pyspark.sql import SparkSession

from notewright.operators import chords, genres
from notewright.schema import PITCH_CLASSES


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def register(spark: SparkSession) -> None:
    """chord_name(root, quality, bass), roman_numeral(root, quality, key_root, mode) and normalize_genre(tag), as SQL functions whose bodies
    are expressions, so they stay inside generated code."""
    names = _array(PITCH_CLASSES)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION chord_name(root INT, quality STRING, bass INT) RETURNS STRING RETURN
        get({names}, root) || CASE quality WHEN 'major' THEN '' WHEN 'minor' THEN 'm' ELSE quality END || CASE WHEN bass IS NULL OR bass = root THEN '' ELSE '/' || get({names}, bass) END""")
    suffix = " ".join(f"WHEN '{q}' THEN '{s}'" for q, s in chords.SUFFIXES.items())
    family = ", ".join(f"'{q}'" for q in chords.MINOR_FAMILY)
    base = f"CASE mode WHEN 'major' THEN get({_array(chords.NUMERALS_MAJOR)}, pmod(root - key_root, 12)) ELSE get({_array(chords.NUMERALS_MINOR)}, pmod(root - key_root, 12)) END"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION roman_numeral(root INT, quality STRING, key_root INT, mode STRING) RETURNS STRING RETURN
        CASE WHEN quality IN ({family}) THEN lower({base}) ELSE upper({base}) END || CASE quality {suffix} ELSE '' END""")
    rows = genres.taxonomy(spark).select("alias", "canonical").collect()
    table = "map(" + ", ".join(f"'{r.alias}', '{r.canonical}'" for r in rows) + ")"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION normalize_genre(tag STRING) RETURNS STRING RETURN
        coalesce(element_at({table}, lower(trim(tag))), element_at({table}, regexp_replace(lower(trim(tag)), ' (music|genre)$', '')))""")
