"""Roles of tracks, scored from their features."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.schema import ROLES


def _points(*rules: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for holds, points in rules:
        total = total + F.when(holds, points).otherwise(0.0)
    return total


def scores() -> dict[str, Column]:
    """A score for each role but the last, in the order that breaks ties."""
    c = F.col
    poly, median, density, duration = c("polyphony_ratio"), c("pitch_median"), c("note_density"), c("avg_duration")
    drum = c("is_channel_10")

    def between(x: Column, low: float, high: float) -> Column:
        return (x > low) & (x < high)

    def few(strong: float, weak: float) -> list[tuple[Column, float]]:
        return [(poly < 0.1, strong), ((poly >= 0.1) & (poly < 0.3), weak)]

    def tuned(*rules: tuple[Column, float]) -> Column:
        return F.when(drum, 0.0).otherwise(_points(*rules))

    return {
        "drums": _points((drum, 3.0), (density > 8, 1.0), (duration < 0.25, 0.5), (c("pitch_class_entropy") < 0.5, 0.5), (c("pitch_range") < 48, 0.3)),
        "bass": tuned((median < 60, 1.5), (c("pitch_max") < 72, 0.5), *few(1.0, 0.3), (between(density, 2, 8), 0.5), (c("pitch_range") < 24, 0.3)),
        "chords": tuned((poly > 0.3, 1.5), (between(median, 48, 84), 0.5), (between(duration, 0.25, 2), 0.5), (density > 2, 0.3)),
        "pad": tuned((poly > 0.3, 1.0), (duration > 2, 1.5), (density < 2, 0.5), (between(median, 48, 84), 0.3)),
        "lead": tuned(*few(1.0, 0.3), (c("pitch_range") > 24, 1.0), (median > 60, 0.5), (c("syncopation") > 0.2, 0.3), (between(duration, 0.25, 1), 0.3)),
        "arp": tuned((density > 8, 1.5), (duration < 0.25, 1.0), (c("repetition_score") > 0.3, 1.0), (poly < 0.3, 0.5), (median > 60, 0.3)),
    }


def role_probabilities(features: DataFrame) -> DataFrame:
    """(song_id, track_id, one column a role, primary_role: the largest, the first of equals). Without a score to speak of a track is `other`.

    The scores stand in one array, so that what builds on them mentions them once, however plans are put together."""
    raw = scores()
    names = [r for r in ROLES if r in raw]

    def shares(s: Column, total: Column) -> Column:
        none = total < 0.1
        return F.concat(F.transform(s, lambda x: F.when(none, 0.0).otherwise(x / total)), F.array(F.when(none, 1.0).otherwise(0.0)))

    def named(p: Column) -> Column:
        first = F.array_position(p, F.array_max(p)).cast("int") - 1
        return F.struct(*[p[k].alias(r) for k, r in enumerate([*names, "other"])], F.get(F.array(*map(F.lit, [*names, "other"])), first).alias("primary_role"))

    def told(s: Column) -> Column:
        sums = F.array(F.aggregate(s, F.lit(0.0), lambda a, x: a + x))
        return F.transform(F.transform(sums, lambda total: shares(s, total)), named)[0]

    out = features.select("song_id", "track_id", F.transform(F.array(F.array(*[raw[r] for r in names])), told)[0].alias("_r"))
    return out.select("song_id", "track_id", *[F.col(f"_r.{r}").alias(r) for r in ROLES], "_r.primary_role")
