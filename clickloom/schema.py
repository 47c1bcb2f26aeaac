"""The fact model: every record is a pedigree and one fact about persons and pages.

A union is a struct with a tag and one nullable member per branch. Equality and order of such
a struct are those of the union: by tag, then by value, so every cookie sorts before every
user id, and a least person of a set is `min` over the structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags and codes of the fact model.
COOKIE, USER_ID = 1, 2
PERSON_PROPERTY, PAGE_PROPERTY, EQUIV, PAGE_VIEW = 1, 2, 3, 4
FULL_NAME, GENDER, LOCATION = 1, 2, 3
PAGE_VIEWS = 1
MALE, FEMALE = 1, 2
SELF, EXTERNAL = 1, 2
PAGE_VIEW_SYSTEM, EXTERNAL_DATA_SYSTEM = 1, 2

UNITS = {"person_property": PERSON_PROPERTY, "page_property": PAGE_PROPERTY, "equiv": EQUIV, "page_view": PAGE_VIEW}
#: Property values per unit; edges have none.
PROPERTIES = {PERSON_PROPERTY: (FULL_NAME, GENDER, LOCATION), PAGE_PROPERTY: (PAGE_VIEWS,), EQUIV: (), PAGE_VIEW: ()}
GENDERS = {MALE: "MALE", FEMALE: "FEMALE"}
SOURCES = {SELF: "SELF", EXTERNAL: "EXTERNAL"}

PERSON = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("cookie", T.StringType()), T.StructField("user_id", T.LongType())])
PAGE = T.StructType([T.StructField("url", T.StringType())])
LOCATION_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("city", "state", "country")])
PERSON_VALUE = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("full_name", T.StringType()), T.StructField("gender", T.IntegerType()), T.StructField("location", LOCATION_TYPE)])
PAGE_VALUE = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("page_views", T.IntegerType())])
PEDIGREE = T.StructType([T.StructField("true_as_of_secs", T.IntegerType()), T.StructField("source", T.IntegerType()), T.StructField("system", T.ByteType())])

#: One row per record. unit says which of the four fact columns is set.
RECORD = T.StructType([
    T.StructField("pedigree", PEDIGREE),
    T.StructField("person_property", T.StructType([T.StructField("id", PERSON), T.StructField("property", PERSON_VALUE)])),
    T.StructField("page_property", T.StructType([T.StructField("id", PAGE), T.StructField("property", PAGE_VALUE)])),
    T.StructField("equiv", T.StructType([T.StructField("id1", PERSON), T.StructField("id2", PERSON)])),
    T.StructField("page_view", T.StructType([T.StructField("person", PERSON), T.StructField("page", PAGE), T.StructField("nonce", T.LongType())])),
    T.StructField("unit", T.ByteType()),
    T.StructField("prop", T.ByteType()),
])
#: A page view as it travels on a stream.
VIEW = T.StructType([T.StructField("user", PERSON), T.StructField("url", T.StringType()), T.StructField("timestamp", T.IntegerType())])


def person_by_id(user_id: Column) -> Column:
    return F.struct(F.lit(USER_ID).cast("byte").alias("tag"), F.lit(None).cast("string").alias("cookie"), user_id.cast("long").alias("user_id"))


def person_by_cookie(cookie: Column) -> Column:
    return F.struct(F.lit(COOKIE).cast("byte").alias("tag"), cookie.cast("string").alias("cookie"), F.lit(None).cast("long").alias("user_id"))


def person_text(person: Column) -> Column:
    """A person as a string that tells cookies from user ids, for sketches and shards."""
    return F.when(person["tag"] == COOKIE, F.concat(F.lit("c:"), person["cookie"])).otherwise(F.concat(F.lit("u:"), person["user_id"].cast("string")))


def pedigree(secs: Column, source: int = SELF, system: int = PAGE_VIEW_SYSTEM) -> Column:
    return F.struct(secs.cast("int").alias("true_as_of_secs"), F.lit(source).cast("int").alias("source"), F.lit(system).cast("byte").alias("system"))


def records(df: DataFrame, unit: int, fact: Column, at: Column, prop: Column | None = None) -> DataFrame:
    """df as records of one unit: at is the pedigree, fact the unit's struct."""
    name = next(n for n, u in UNITS.items() if u == unit)
    return df.select(*[
        at.cast(f.dataType).alias("pedigree") if f.name == "pedigree"
        else F.lit(unit).cast("byte").alias("unit") if f.name == "unit"
        else (prop if prop is not None else F.lit(0)).cast("byte").alias("prop") if f.name == "prop"
        else (fact if f.name == name else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RECORD
    ])


def page_views(df: DataFrame, person: Column, url: Column, secs: Column, nonce: Column | None = None) -> DataFrame:
    fact = F.struct(person.alias("person"), F.struct(url.alias("url")).alias("page"), (nonce if nonce is not None else F.lit(1)).cast("long").alias("nonce"))
    return records(df, PAGE_VIEW, fact, pedigree(secs))


def equivalences(df: DataFrame, one: Column, two: Column, secs: int = 1000) -> DataFrame:
    return records(df, EQUIV, F.struct(one.alias("id1"), two.alias("id2")), pedigree(F.lit(secs)))


def person_properties(df: DataFrame, person: Column, secs: Column, full_name: Column | None = None, gender: Column | None = None, location: Column | None = None) -> DataFrame:
    """Exactly one of full_name, gender and location is given."""
    given = {FULL_NAME: full_name, GENDER: gender, LOCATION: location}
    tag, = [k for k, v in given.items() if v is not None]
    value = F.struct(F.lit(tag).cast("byte").alias("tag"), *[(F.lit(None) if v is None else v).cast(PERSON_VALUE[k].dataType).alias(PERSON_VALUE[k].name) for k, v in given.items()])
    return records(df, PERSON_PROPERTY, F.struct(person.alias("id"), value.alias("property")), pedigree(secs), F.lit(tag))


def page_properties(df: DataFrame, url: Column, secs: Column, views: Column) -> DataFrame:
    value = F.struct(F.lit(PAGE_VIEWS).cast("byte").alias("tag"), views.cast("int").alias("page_views"))
    return records(df, PAGE_PROPERTY, F.struct(F.struct(url.alias("url")).alias("id"), value.alias("property")), pedigree(secs), F.lit(PAGE_VIEWS))


def _person_ok(p: Column) -> Column:
    return F.coalesce(((p["tag"] == COOKIE) & p["cookie"].isNotNull() & p["user_id"].isNull()) | ((p["tag"] == USER_ID) & p["user_id"].isNotNull() & p["cookie"].isNull()), F.lit(False))


def is_valid() -> Column:
    """Whether a record has all required fields, and just the branch that its tags name."""
    c = F.col
    given = [c(n).isNotNull().cast("int") for n in UNITS]
    person, page = c("person_property"), c("page_property")
    value, views = person["property"], page["property"]
    checks = {
        "person_property": _person_ok(person["id"]) & (value["tag"] == c("prop")) & (
            ((value["tag"] == FULL_NAME) & value["full_name"].isNotNull()) | ((value["tag"] == GENDER) & value["gender"].isin(MALE, FEMALE)) | ((value["tag"] == LOCATION) & value["location"].isNotNull())
        ),
        "page_property": page["id"]["url"].isNotNull() & (views["tag"] == c("prop")) & (views["tag"] == PAGE_VIEWS) & views["page_views"].isNotNull(),
        "equiv": _person_ok(c("equiv")["id1"]) & _person_ok(c("equiv")["id2"]) & (c("prop") == 0),
        "page_view": _person_ok(c("page_view")["person"]) & c("page_view")["page"]["url"].isNotNull() & c("page_view")["nonce"].isNotNull() & (c("prop") == 0),
    }
    fits = F.lit(False)
    for name, unit in UNITS.items():
        fits = F.when(c("unit") == unit, c(name).isNotNull() & checks[name]).otherwise(fits)
    p = c("pedigree")
    return F.coalesce((sum(given[1:], given[0]) == 1) & fits & p["true_as_of_secs"].isNotNull() & p["source"].isin(*SOURCES) & p["system"].isin(PAGE_VIEW_SYSTEM, EXTERNAL_DATA_SYSTEM), F.lit(False))
