from notewright import functions


def test_sql_functions(spark):
    functions.register(spark)
    row = spark.sql("SELECT chord_name(9, 'minor', 0) AS a, chord_name(7, '7', NULL) AS b, roman_numeral(11, 'dim', 0, 'major') AS c, normalize_genre(' Hip Hop ') AS d, normalize_genre('rock music') AS e, normalize_genre('zzz') AS f").first()
    assert tuple(row) == ("Am/C", "G7", "vii°", "hip-hop", "rock", None)
