"""Genre tags: names, other spellings and categories, and merging what several sources say."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Canonical names by category, in order, and the spellings of each besides its own.
CATEGORIES: dict[str, dict[str, list[str]]] = {
    "rock": {
        "rock": ["rock and roll", "rock & roll", "rock n roll"],
        "classic rock": [],
        "hard rock": [],
        "soft rock": [],
        "progressive rock": ["prog rock", "prog"],
        "alternative rock": ["alt rock", "alternative"],
        "indie rock": ["indie"],
        "grunge": [],
        "psychedelic rock": ["psychedelic"],
        "garage rock": [],
        "southern rock": [],
        "glam rock": [],
        "art rock": [],
    },
    "pop": {
        "pop": ["pop music"],
        "synth-pop": ["synth pop", "synthpop"],
        "electro-pop": ["electropop", "electro pop"],
        "dance-pop": ["dance pop"],
        "art pop": [],
        "indie pop": [],
        "chamber pop": [],
        "dream pop": [],
        "power pop": [],
        "teen pop": [],
        "k-pop": ["kpop"],
        "j-pop": ["jpop"],
    },
    "electronic": {
        "electronic": ["electronica"],
        "edm": ["electronic dance music"],
        "house": [],
        "deep house": [],
        "tech house": [],
        "progressive house": [],
        "techno": [],
        "trance": [],
        "progressive trance": [],
        "psytrance": ["psy trance"],
        "drum and bass": ["drum & bass", "dnb", "d&b"],
        "dubstep": [],
        "breakbeat": ["breaks"],
        "idm": ["intelligent dance music"],
        "downtempo": [],
        "chillout": ["chill out", "chill-out"],
        "trip-hop": ["trip hop", "triphop"],
    },
    "jazz": {
        "jazz": [],
        "smooth jazz": [],
        "jazz fusion": ["fusion"],
        "bebop": ["be-bop"],
        "free jazz": [],
        "cool jazz": [],
        "swing": [],
        "big band": [],
        "latin jazz": [],
        "acid jazz": [],
        "nu-jazz": ["nu jazz"],
    },
    "classical": {
        "classical": ["classical music"],
        "baroque": [],
        "romantic": [],
        "contemporary classical": ["modern classical"],
        "minimalism": ["minimalist"],
        "opera": [],
        "symphony": [],
        "orchestral": [],
        "chamber music": [],
        "choral": [],
    },
    "hip-hop": {
        "hip-hop": ["hip hop", "hiphop", "rap"],
        "trap": [],
        "boom bap": [],
        "gangsta rap": [],
        "conscious hip-hop": ["conscious hip hop"],
        "alternative hip-hop": ["alternative hip hop"],
        "underground hip-hop": ["underground hip hop"],
        "east coast hip-hop": ["east coast hip hop"],
        "west coast hip-hop": ["west coast hip hop"],
        "southern hip-hop": ["southern hip hop"],
        "crunk": [],
        "grime": [],
    },
    "r&b": {"r&b": ["rnb", "rhythm and blues"], "contemporary r&b": [], "neo-soul": ["neo soul"], "new jack swing": []},
    "country": {
        "country": ["country music"],
        "country rock": [],
        "outlaw country": [],
        "alt-country": ["alt country", "alternative country"],
        "americana": [],
        "bluegrass": [],
        "honky tonk": [],
    },
    "folk": {"folk": ["folk music"], "folk rock": [], "indie folk": [], "contemporary folk": [], "traditional folk": [], "singer-songwriter": ["singer songwriter"]},
    "blues": {"blues": ["blues music"], "electric blues": [], "delta blues": [], "chicago blues": [], "blues rock": []},
    "metal": {
        "metal": [],
        "heavy metal": [],
        "thrash metal": ["thrash"],
        "death metal": [],
        "black metal": [],
        "doom metal": [],
        "power metal": [],
        "progressive metal": ["prog metal"],
        "nu-metal": ["nu metal"],
        "metalcore": [],
        "deathcore": [],
        "symphonic metal": [],
    },
    "punk": {"punk": [], "punk rock": [], "hardcore punk": ["hardcore"], "post-punk": ["post punk"], "pop punk": ["pop-punk"], "emo": [], "screamo": [], "ska punk": []},
    "reggae": {"reggae": [], "dub": [], "ska": [], "dancehall": [], "roots reggae": [], "rocksteady": []},
    "latin": {
        "latin": ["latin music"],
        "salsa": [],
        "bachata": [],
        "merengue": [],
        "reggaeton": ["reggaetón"],
        "bossa nova": [],
        "samba": [],
        "tango": [],
        "cumbia": [],
        "latin pop": [],
    },
    "world": {"world": ["world music"], "afrobeat": [], "afropop": [], "celtic": [], "flamenco": [], "indian classical": [], "middle eastern": []},
    "soul": {"soul": ["soul music"], "motown": [], "northern soul": []},
    "funk": {"funk": [], "p-funk": [], "disco": [], "nu-disco": ["nu disco"]},
    "ambient": {"ambient": ["ambient music"], "dark ambient": [], "drone": [], "new age": []},
    "experimental": {"experimental": [], "avant-garde": ["avant garde"], "noise": [], "industrial": [], "post-rock": ["post rock"], "math rock": [], "shoegaze": []},
    "soundtrack": {"soundtrack": ["film soundtrack"], "film score": [], "video game music": ["game music", "vgm"], "anime soundtrack": ["anime"]},
}
# How much a source counts, and one that is not named.
WEIGHTS = {"musicbrainz": 1.0, "discogs": 0.9, "lastfm": 0.7, "spotify": 0.8, "user": 0.5, "filename": 0.3}
OTHER_WEIGHT = 0.5


def spellings(name: str, others: list[str]) -> list[str]:
    """A name's own spelling and the others; kinds of hip-hop are only known by the others."""
    return others if name.endswith(" hip-hop") else [name, *others]


def taxonomy(spark: SparkSession, aliases: DataFrame | None = None) -> DataFrame:
    """(alias, canonical, category, place). A caller's own table of (alias, canonical, category) comes before the built-in one."""
    rows = [(alias, name, category) for category, names in CATEGORIES.items() for name, others in names.items() for alias in spellings(name, others)]
    own = spark.createDataFrame([(*row, k) for k, row in enumerate(rows)], "alias string, canonical string, category string, place int")
    if aliases is None:
        return own
    return aliases.select("alias", "canonical", "category", F.lit(-1).alias("place")).union(own.join(aliases, "alias", "left_anti").select(own.columns))


def cleaned(tag: Column) -> Column:
    return F.lower(F.regexp_replace(tag, r"(?U)^\s+|\s+$", ""))


def normalize(tags: DataFrame, names: DataFrame, tag: str = "tag") -> DataFrame:
    """tags with canonical and category (null if unknown): the tag itself, or without " music" or " genre" at its end. The table of names is
    small and fixed, so it is broadcast."""
    table = F.broadcast(names.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"), F.col("category").alias("_g")))
    short = table.select(F.col("_a").alias("_a2"), F.col("_c").alias("_c2"), F.col("_g").alias("_g2"))
    keyed = tags.withColumn("_k", cleaned(F.col(tag))).withColumn("_s", F.regexp_replace("_k", " (music|genre)$", ""))
    found = keyed.join(table, F.col("_k") == F.col("_a"), "left").join(F.broadcast(short), F.col("_s") == F.col("_a2"), "left")
    return found.withColumns({"canonical": F.coalesce("_c", "_c2"), "category": F.coalesce("_g", "_g2")}).select(*tags.columns, "canonical", "category")


def source_weight(source: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in WEIGHTS.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def merge(tags: DataFrame, by: list[str]) -> DataFrame:
    """tags (by, canonical, source, place) -> (by, canonical, sources, confidence, rank): the first source sets the confidence, each further adds
    three tenths of its weight, to 1 at most; strongest first, then in order of appearance."""
    known = tags.where("canonical is not null").groupBy(*by, "canonical", "source").agg(F.min("place").alias("place"))
    listed = known.groupBy(*by, "canonical").agg(F.array_sort(F.collect_list(F.struct("place", source_weight(F.col("source")).alias("w")))).alias("s"), F.min("place").alias("first"))
    confidence = F.aggregate("s", F.lit(-1.0), lambda a, x: F.when(a < 0, x["w"]).otherwise(F.least(F.lit(1.0), a + 0.3 * x["w"])))
    scored = listed.select(*by, "canonical", F.size("s").alias("sources"), confidence.alias("confidence"), "first")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("confidence").desc(), "first", "canonical")))


def result(merged: DataFrame, tags: DataFrame, by: list[str], secondary: int = 3) -> DataFrame:
    """(by, primary, secondary, overall): overall is the best agreement among sources, or with one source its confidence."""
    sources = tags.groupBy(*by).agg(F.count_distinct("source").alias("n"))
    agg = merged.groupBy(*by).agg(
        F.max(F.when(F.col("rank") == 1, F.col("canonical"))).alias("primary"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rank") <= 1 + secondary), F.struct("rank", "canonical")))), lambda x: x["canonical"]).alias("secondary"),
        F.max("sources").alias("most"),
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("top"),
    )
    return sources.join(agg, by, "left").select(*by, "primary", F.coalesce("secondary", F.array()).alias("secondary"), F.when(F.col("primary").isNull(), 0.0).when(F.col("n") > 1, F.col("most") / F.col("n")).otherwise(F.col("top")).alias("overall"))


def suggest(names: DataFrame, words: DataFrame, limit: int = 10) -> DataFrame:
    """words (word) -> (word, canonical): for each word the first `limit` names of which some spelling has it in it, whatever its case."""
    held = words.join(F.broadcast(names), F.contains(F.col("alias"), F.lower("word"))).groupBy("word", "canonical").agg(F.min("place").alias("place"))
    rank = F.row_number().over(W.partitionBy("word").orderBy("place", "canonical"))
    return held.withColumn("rank", rank).where(F.col("rank") <= limit).select("word", "canonical")


def in_category(names: DataFrame, category: str) -> DataFrame:
    return names.where(F.col("category") == category).select("canonical").distinct()


# Words that a genre's name has in it, the length below which any tag counts as one, and how many genres and tags are shown.
GENRE_WORDS = [
    "rock", "pop", "jazz", "electronic", "classical", "metal", "hip hop", "r&b", "country", "folk", "blues", "soul", "funk",
    "reggae", "punk", "indie", "alternative", "dance", "house", "techno", "trance", "ambient", "soundtrack", "world",
]
SHORT, GENRES_SHOWN, TAGS_SHOWN = 15, 15, 20


def ranked_tags(tags: DataFrame, by: list[str]) -> DataFrame:
    """tags (by, tag, count, place) -> (by, genres, tags): the most counted tags first, each with the largest of its counts, then in order of
    appearance; the first TAGS_SHOWN of all, and the first GENRES_SHOWN of those that look like genres."""
    most = tags.where("tag <> ''").groupBy(*by, "tag").agg(F.max("count").alias("count"), F.min("place").alias("place"))
    low = F.lower("tag")
    like = F.length("tag") < SHORT
    for word in GENRE_WORDS:
        like = like | F.contains(low, F.lit(word))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("count").desc(), "place", "tag"))
    ranked = most.withColumns({"rank": rank, "like": like})
    nth = F.sum(F.col("like").cast("int")).over(W.partitionBy(*by).orderBy("rank"))
    kept = ranked.withColumn("nth", nth).where((F.col("rank") <= TAGS_SHOWN) | (F.col("like") & (F.col("nth") <= GENRES_SHOWN)))
    listed = lambda holds: F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("rank", "tag")))), lambda x: x["tag"])
    return kept.groupBy(*by).agg(listed(F.col("like") & (F.col("nth") <= GENRES_SHOWN)).alias("genres"), listed(F.col("rank") <= TAGS_SHOWN).alias("tags"))
