"""One text document a replica row, for search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import text_or_empty


def skipped(op: Column, unchanged: Column, embedded: Sequence[str]) -> Column:
    """An update that left an embedded column unchanged needs no new document."""
    return (op == "u") & F.coalesce(F.arrays_overlap(unchanged, F.array(*[F.lit(c) for c in embedded])), F.lit(False))


def to_render(folded: DataFrame, embedded: Mapping[str, Sequence[str]]) -> DataFrame:
    """Folded changes of embedded tables that ask for a document."""
    keep = F.lit(False)
    for table, columns in embedded.items():
        keep = keep | ((F.col("table") == table) & ~skipped(F.col("op"), F.col("still_unchanged"), columns))
    return folded.where(keep & (F.col("op") != "d"))


def deleted(folded: DataFrame, embedded: Mapping[str, Sequence[str]]) -> DataFrame:
    return folded.where(F.col("table").isin(*embedded) & (F.col("op") == "d"))


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, dim_key: str, name: Column, alias: str, fallback: str) -> DataFrame:
    """Add a name from a dimension; ``fallback`` and the key where it is missing. Spark broadcasts the dimension if it is small."""
    d = dimension.select(F.col(dim_key).alias("__k"), name.alias("__n")).dropDuplicates(["__k"])
    out = rows.join(d, F.col(key) == F.col("__k"), "left")
    return out.withColumn(alias, F.coalesce("__n", F.concat(F.lit(fallback + " "), text_or_empty(F.col(key))))).drop("__k", "__n")


#: The documents' formats, what stands for a row by name, and the note of a demonstration row.
ANIMAL = "%s is a %s, status %s, animal id %s. Home: %s."
OBSERVATION = "Observation %s of %s at %s on %s: %s"
ANIMAL_NAME, HOLE_NAME = "%s (%s, animal %s)", "%s (watering hole %s)"
RANGER_LOG = "Ranger log: %s the %s seen resting alone at %s, %s."
#: Tables with documents and the columns that these show.
EMBEDDED = {
    "public.animals": ["name", "species", "status", "home_watering_hole_id"],
    "public.observations": ["animal_id", "watering_hole_id", "observed_at", "notes"],
}
#: The places of demonstration rows, and where a note's place stands.
PLACES = ("the north ridge", "the south bank", "the reed bed", "the shallows", "the acacia line", "the dry channel", "the salt lick", "the far shore")
PLACE_SUFFIX = r",[^,]*\.\s*$"


def spaced(code: Column) -> Column:
    """A code with spaces for underscores."""
    return F.replace(text_or_empty(code), F.lit("_"), F.lit(" "))


def animal_text(name: Column, species: Column, status: Column, animal_id: Column, home: Column) -> Column:
    return F.format_string(ANIMAL, text_or_empty(name), spaced(species), text_or_empty(status), text_or_empty(animal_id), home)


def observation_text(observation_id: Column, animal: Column, place: Column, at: Column, notes: Column) -> Column:
    """A sentence on an observation; without notes it says so."""
    said = F.coalesce(F.nullif(F.trim(text_or_empty(notes)), F.lit("")), F.lit("no notes"))
    return F.format_string(OBSERVATION, text_or_empty(observation_id), animal, place, text_or_empty(at), said)


def ranger_log(name: Column, species: Column, hole: Column, place: Column) -> Column:
    return F.format_string(RANGER_LOG, text_or_empty(name), spaced(species), text_or_empty(hole), place)


def wildlife(folded: DataFrame, animals: DataFrame, holes: DataFrame) -> DataFrame:
    """Folded animals and observations, as asked for by ``to_render``, with ``text``."""
    rows = looked_up(folded, holes, "watering_hole_id", "watering_hole_id", F.format_string(HOLE_NAME, "name", F.col("watering_hole_id").cast("string")), "at_hole", "watering hole")
    rows = looked_up(rows, holes, "home_watering_hole_id", "watering_hole_id", F.format_string(HOLE_NAME, "name", F.col("watering_hole_id").cast("string")), "home", "watering hole")
    seen = F.format_string(ANIMAL_NAME, F.col("name"), spaced(F.col("species")), F.col("animal_id").cast("string"))
    rows = looked_up(rows, animals, "animal_id", "animal_id", seen, "who", "animal")
    key = lambda c: F.try_element_at("pk", F.lit(c))
    animal = animal_text(F.col("name"), F.col("species"), F.col("status"), key("animal_id"), F.col("home"))
    observation = observation_text(key("observation_id"), F.col("who"), F.col("at_hole"), F.col("observed_at"), F.col("notes"))
    return rows.withColumn("text", F.when(F.col("table") == "public.animals", animal).otherwise(observation)).drop("at_hole", "home", "who")


def vector_rows(rendered: DataFrame, embed: Column, applied: Column) -> DataFrame:
    """table, pk_key, text, embedding, commit_ts, updated_at from rendered rows (table, pk_key, text, commit_ts)."""
    return rendered.select("table", "pk_key", "text", embed.alias("embedding"), "commit_ts", applied.cast("timestamp").alias("updated_at"))
