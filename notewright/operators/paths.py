"""Artist and title of a song: from its path, and from what its file says."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators between artist and title in order of trust, site names that file names carry, endings of file names.
SEPARATORS = [" - ", " – ", " — ", "_-_", "__"]
DOMAINS = ["nonstop2k.com", "midi-karaoke.info", "freemidi.org", "midiworld.com"]
ENDINGS = [".mid", ".midi", ".kar"]
# Names of the rules, and how sure each is.
MIDI, FOLDER, SEPARATOR = ("midi_metadata", 0.7), ("folder_structure", 0.8), ("filename_separator", 0.6)
KNOWN, KNOWN_UNTITLED, HEURISTIC = ("filename_nonstop2k", 0.8), ("filename_nonstop2k", 0.3), ("filename_nonstop2k_heuristic", 0.4)
HYPHENS, ONE_WORD, WHOLE = ("filename_hyphenated", 0.5), ("filename_hyphenated", 0.3), ("filename_fallback", 0.3)
GUESS = "struct<artist:string,title:string,source:string,confidence:double>"


def guess(artist: Column, title: Column, rule: tuple[str, float]) -> Column:
    return F.struct(artist.alias("artist"), title.alias("title"), F.lit(rule[0]).alias("source"), F.lit(rule[1]).alias("confidence"))


def title_case(text: Column) -> Column:
    """Capitals at the start and after every character that is not a letter."""

    def cased(letters: Column) -> Column:
        return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")

    return F.transform(F.array(F.split(F.lower(text), "")), cased)[0]


def clean_title(text: Column) -> Column:
    return title_case(F.trim(F.regexp_replace(F.regexp_replace(text, "[_-]", " "), r"\s+", " ")))


def clean_stem(stem: Column) -> Column:
    for d in DOMAINS:
        stem = F.replace(stem, F.lit(d), F.lit(""))
    return F.trim(F.regexp_replace(stem, r"\d{8,}", ""), F.lit("-_ "))


def looks_like_filename(text: Column) -> Column:
    low = F.lower(text)
    found = text.rlike(r"\d{8,}") | (F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit(""))) >= 3)
    for d in DOMAINS:
        found = found | F.contains(low, F.lit(d))
    for e in ENDINGS:
        found = found | F.endswith(low, F.lit(e))
    return found


def from_copyright(text: Column) -> Column:
    """The artist that a copyright line names; empty if none."""
    out = F.lit("")
    # What stands before the name, in order of trust.
    for pattern in reversed([r"©\s*\d{4}\s+(.+)", r"[Cc]opyright\s+(?:\d{4}\s+)?(.+)", r"by\s+(.+)"]):
        out = F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1))).otherwise(out)
    return out


def from_midi(title: Column, copyright: Column) -> Column:
    """What the file itself says: sure only if it has a title."""
    artist, title = F.coalesce(from_copyright(copyright), F.lit("")), F.coalesce(title, F.lit(""))
    sure = F.struct(artist.alias("artist"), title.alias("title"), F.lit(MIDI[0]).alias("source"), F.when(title != "", MIDI[1]).otherwise(0.0).alias("confidence"))
    return F.when((artist != "") | (title != ""), sure)


def from_folders(parts: Column, stem: Column) -> Column:
    """.../R/Ramones/title: a folder of one letter above the artist's."""
    letter, artist = F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 2)
    return F.when(letter.rlike(r"^\p{L}$"), guess(artist, clean_title(stem), FOLDER))


def from_separator(stem: Column) -> Column:
    """Before and after the first separator. (A dash alone between underscores is the fourth separator, two underscores are the fifth.)"""
    out = F.lit(None).cast(GUESS)
    for s in reversed(SEPARATORS):
        at = F.instr(stem, s)
        out = F.when(at > 0, guess(clean_title(F.substr(stem, F.lit(1), at - 1)), clean_title(F.substr(stem, at + len(s))), SEPARATOR)).otherwise(out)
    return out


def is_number(word: Column) -> Column:
    return word.rlike(r"^\p{Nd}+$")


def segment(stem: Column, known: Column | None = None) -> Column:
    """artist-slug[-artist-slug...]-title. known (of `known_artists`): names of the artists that it begins with, and the words these take. Without
    a known artist the first two of three words are the artist, or the first half of more."""
    words = F.split(F.lower(stem), "-")
    rest = F.filter(words, lambda w: ~is_number(w))
    joined = lambda x: title_case(F.array_join(x, " "))

    def halves(x: Column) -> Column:
        n = F.when(F.size(x) == 3, 2).otherwise(F.floor(F.size(x) / 2)).cast("int")
        return F.when(F.size(x) >= 3, guess(joined(F.slice(x, F.lit(1), n)), joined(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))), HEURISTIC))

    by_words = F.transform(F.array(rest), halves)[0]
    if known is None:
        return by_words
    left = F.filter(F.slice(words, known["words"] + 1, F.size(words)), lambda w: ~is_number(w))
    artist = F.array_join(known["names"], ", ")
    named = F.when(F.size(left) > 0, guess(artist, joined(left), KNOWN)).otherwise(guess(artist, F.lit(""), KNOWN_UNTITLED))
    return F.when(F.size(words) >= 2, F.when(known.isNotNull(), named).otherwise(by_words))


def known_artists(stems: DataFrame, slugs: DataFrame) -> DataFrame:
    """stems (stem), slugs (slug, name) -> (stem, known: names, words) of the stems that begin with a known slug: again and again the longest one that the
    words go on with.

    Every run of words of a stem, up to the longest slug's number of words, meets the dictionary by one equi-join, of any size on both sides; what is found is walked from
    word to word within a stem's row. Of repeated slugs the least name counts.
    """
    one = slugs.where("slug is not null").groupBy(F.lower("slug").alias("slug")).agg(F.min("name").alias("name"))
    longest = one.agg(F.max(F.size(F.split("slug", "-")))).first()[0] or 0
    cut_up = stems.select("stem").distinct().withColumn("w", F.split(F.lower("stem"), "-")).where(F.size("w") >= 2)
    most = lambda at: F.least(F.lit(longest), F.size("w") - at)
    at = cut_up.select("stem", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at"))
    runs = at.where(most(F.col("at")) >= 1).select("stem", "at", "w", F.explode(F.sequence(F.lit(1), most(F.col("at")))).alias("n"))
    met = runs.select("stem", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), "-").alias("slug")).join(one, "slug")
    best = met.groupBy("stem", "at").agg(F.max(F.struct("n", "name")).alias("x"))
    listed = best.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("found"))

    def step(a: Column, _: Column) -> Column:
        return F.transform(F.array(F.element_at("found", a["words"])), lambda x: F.when(x.isNull(), a).otherwise(F.struct((a["words"] + x["n"]).alias("words"), F.concat(a["names"], F.array(x["name"])).alias("names"))))[0]

    start = F.struct(F.lit(0).alias("words"), F.array().cast("array<string>").alias("names"))
    walked = listed.withColumn("known", F.aggregate(F.sequence(F.lit(1), F.size("found")), start, step))
    return walked.where("known.words > 0").select("stem", "known")


def from_hyphens(stem: Column) -> Column:
    """Words between hyphens, numbers left out: one is the title, of two the first is the artist. (`segment` has those of three.)"""
    words = F.filter(F.transform(F.split(stem, "-"), lambda w: F.trim(w)), lambda w: (w != "") & ~is_number(w))
    one = guess(F.lit(""), title_case(F.get(words, F.lit(0))), ONE_WORD)
    two = guess(title_case(F.get(words, F.lit(0))), title_case(F.get(words, F.lit(1))), HYPHENS)
    return F.when(F.contains(stem, F.lit("-")), F.when(F.size(words) == 1, one).when(F.size(words) == 2, two))


def metadata(files: DataFrame, path: str = "path", slugs: DataFrame | None = None, title: Column | None = None, copyright: Column | None = None) -> DataFrame:
    """files with artist, title, source, confidence: the surest of what the file says (its title and copyright line, if given), its folders
    and its name; gaps are filled by the next. Artist and title may be empty. slugs: (slug, name) of known artists."""
    parts = F.split(F.regexp_replace(path, "/+", "/"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+$", "")
    clean = clean_stem(stem)
    inside = from_midi(F.lit("") if title is None else title, F.lit("") if copyright is None else copyright)
    given, known = files, None
    if slugs is not None:
        found = known_artists(files.select(clean.alias("stem")), slugs).withColumnRenamed("stem", "_stem")
        files, known = files.join(found.withColumnRenamed("known", "_known"), clean == F.col("_stem"), "left"), F.col("_known")
    name = F.coalesce(from_separator(clean), segment(clean, known), from_hyphens(clean), guess(F.lit(""), clean_title(clean), WHOLE))
    told = F.filter(F.array(inside, from_folders(parts, stem), name), lambda g: g.isNotNull())
    ranked = F.array_sort(F.transform(told, lambda g, k: F.struct((-g["confidence"]).alias("o"), k.alias("k"), g.alias("g"))))
    out = files.withColumn("_r", ranked)
    first = lambda f: F.coalesce(F.get(F.filter(F.transform("_r", lambda x: x["g"][f]), lambda v: v != ""), F.lit(0)), F.lit(""))
    best = F.get("_r", F.lit(0))["g"]
    return out.select(*given.columns, first("artist").alias("artist"), first("title").alias("title"), best["source"].alias("source"), best["confidence"].alias("confidence"))


def songs(files: DataFrame, titles: DataFrame, path: str = "path", slugs: DataFrame | None = None) -> DataFrame:
    """files (song_id, path) with what `sources.smf.titles` read from them."""
    told = titles.select("song_id", F.col("title").alias("_title"), F.col("copyright").alias("_copyright"))
    return metadata(files.join(told, "song_id", "left"), path, slugs, F.col("_title"), F.col("_copyright")).drop("_title", "_copyright")
