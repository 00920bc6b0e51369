"""A table of web answers with a time to live, and a client that waits between calls. The transport is the caller's: nothing here opens
a connection by itself."""

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.operators import changes

# Days that an answer lives, by source.
DAYS = {"search": 1, "musicbrainz": 7, "discogs": 7, "lastfm": 7}


def key(source: str, question: dict) -> str:
    return hashlib.sha256(f"{source}:{json.dumps(question, sort_keys=True)}".encode()).hexdigest()


def expires() -> F.Column:
    days = F.lit(7)
    for source, n in DAYS.items():
        days = F.when(F.col("source") == source, n).otherwise(days)
    return F.col("stored") + days * 86400


def is_fresh(now: float) -> F.Column:
    return expires() > now


def fresh(cache: DataFrame, now: float) -> DataFrame:
    """Rows (key, source, body, stored) that have not expired."""
    return cache.where(is_fresh(now))


def stats(cache: DataFrame, now: float) -> DataFrame:
    """(answers, size, live, expired): one row."""
    live = F.count_if(is_fresh(now))
    return cache.agg(F.count(F.lit(1)).alias("answers"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("size"), live.alias("live"), (F.count(F.lit(1)) - live).alias("expired"))


def missing(questions: DataFrame, cache: DataFrame, now: float) -> DataFrame:
    """Questions (key, ...) without a fresh answer."""
    return questions.join(fresh(cache, now).select("key"), "key", "left_anti")


def put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """cache with answers (key, source, body, stored), the youngest of each key."""
    return changes.merged(cache, answers, "key", "stored")


def remove(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key").distinct(), "key", "left_anti")


def clear(cache: DataFrame, source: str | None = None) -> DataFrame:
    """cache without all answers, or without those of a source."""
    return cache.where(F.lit(False) if source is None else ~F.col("source").eqNullSafe(F.lit(source)))


def cleanup(cache: DataFrame, now: float) -> DataFrame:
    """cache without answers whose time has come; those that expire right now stay, though they are no longer given out."""
    return cache.where(F.coalesce(expires() >= now, F.lit(True)))


class Client:
    """Calls transport(question), at least `gap` seconds apart; errors double the wait, to five minutes at most."""

    def __init__(self, transport: Callable[[dict], dict], gap: float = 1.0, tries: int = 5, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.transport, self.gap, self.tries, self.sleep, self.clock, self.last = transport, gap, tries, sleep, clock, float("-inf")

    def __call__(self, question: dict) -> dict | None:
        for attempt in range(self.tries):
            wait = self.last + self.gap - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return self.transport(question)
            except OSError:
                self.sleep(min(300.0, 2.0**attempt))
        return None


NAMED = "struct<name:string,count:int>"


def _credit(c: str) -> F.Column:
    """The first credited artist's name."""
    return F.get(F.col(f"{c}.artist-credit"), F.lit(0))["artist"]["name"]


def _tags(c: str) -> F.Column:
    return F.coalesce(F.transform(F.col(f"{c}.tags"), lambda t: t["name"]), F.array().cast("array<string>"))


def recordings(answers: DataFrame) -> DataFrame:
    """answers (key, body) -> (key, place, id, title, artist, tags): nested JSON as columns, the first credit only."""
    schema = f"struct<recordings:array<struct<id:string,title:string,`artist-credit`:array<struct<artist:struct<name:string>>>,tags:array<{NAMED}>>>>"
    rows = answers.select("key", F.posexplode(F.from_json("body", schema)["recordings"]).alias("place", "r"))
    return rows.select("key", "place", F.col("r.id").alias("id"), F.col("r.title").alias("title"), _credit("r").alias("artist"), _tags("r").alias("tags"))


def artists(answers: DataFrame) -> DataFrame:
    """answers (key, body) -> (key, place, id, name, sort_name, country, type, tags)."""
    schema = f"struct<artists:array<struct<id:string,name:string,`sort-name`:string,country:string,type:string,tags:array<{NAMED}>>>>"
    rows = answers.select("key", F.posexplode(F.from_json("body", schema)["artists"]).alias("place", "r"))
    return rows.select("key", "place", F.col("r.id").alias("id"), F.col("r.name").alias("name"), F.col("r.sort-name").alias("sort_name"), F.col("r.country").alias("country"), F.col("r.type").alias("type"), _tags("r").alias("tags"))


def releases(answers: DataFrame) -> DataFrame:
    """answers (key, body) -> (key, place, id, title, artist, date, country, label, tags): the first credit and the first label only."""
    schema = f"struct<releases:array<struct<id:string,title:string,date:string,country:string,`artist-credit`:array<struct<artist:struct<name:string>>>,`label-info`:array<struct<label:struct<name:string>>>,tags:array<{NAMED}>>>>"
    rows = answers.select("key", F.posexplode(F.from_json("body", schema)["releases"]).alias("place", "r"))
    label = F.get(F.col("r.label-info"), F.lit(0))["label"]["name"]
    return rows.select("key", "place", F.col("r.id").alias("id"), F.col("r.title").alias("title"), _credit("r").alias("artist"), F.col("r.date").alias("date"), F.col("r.country").alias("country"), label.alias("label"), _tags("r").alias("tags"))


def by_id(answers: DataFrame, kind: str) -> DataFrame:
    """answers (key, body) to questions by id, whose body is one thing and not a list: as `recordings`, `artists` or `releases` give it, a row each."""
    parse = {"recording": recordings, "artist": artists, "release": releases}[kind]
    return parse(answers.where("body is not null").select("key", F.concat(F.lit(f'{{"{kind}s":['), "body", F.lit("]}")).alias("body"))).drop("place")


def genre_tags(*parsed: DataFrame) -> DataFrame:
    """(key, tags): the sorted union of the tags of recordings, releases or artists."""
    every = None
    for p in parsed:
        rows = p.select("key", F.explode("tags").alias("tag"))
        every = rows if every is None else every.union(rows)
    return every.groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def lookup(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions (key, title, artist, ...) with the first recording that their answer (key, body) has, its tags, and how sure the match is;
    without an answer they stay, with a confidence of zero."""
    best = recordings(answers).where("place = 0").select("key", F.col("id").alias("found_id"), F.col("title").alias("found_title"), F.col("artist").alias("found_artist"), "tags")
    out = questions.join(best, "key", "left")
    sure = match_confidence(F.col("title"), F.col("artist"), F.col("found_title"), F.col("found_artist"))
    return out.withColumn("confidence", F.when(F.col("found_title").isNull(), 0.0).otherwise(sure))


def match_confidence(asked_title: F.Column, asked_artist: F.Column, title: F.Column, artist: F.Column) -> F.Column:
    """.9 if both are found in the answer, .6 if one is, else .3."""
    inside = lambda a, b: F.coalesce(F.contains(F.lower(b), F.lower(a)), F.lit(False)).cast("int")
    hits = inside(asked_title, title) + inside(asked_artist, artist)
    return F.when(hits == 2, 0.9).when(hits == 1, 0.6).otherwise(0.3)
