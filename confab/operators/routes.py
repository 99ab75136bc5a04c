"""Routes and decisions of access."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, title, path and whether it is open to all. Fixed values.
ROUTES = [
    ("signin", "Sign In", "/signin", True),
    ("signup", "Sign Up", "/signup", True),
    ("chat", "Chat", "/chat", False),
]
#: Extensions of static files, for which no decision is made. Fixed values.
STATIC = r"html?|css|js(?!on)|jpe?g|webp|png|gif|svg|ttf|woff2?|ico|csv|docx?|xlsx?|zip|webmanifest"
#: Paths for which a decision is always made, also where they look like static files. Fixed values.
ALWAYS = (r"^/(api|trpc)(.*)$", r"^/__clerk/(.*)$")


def route_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "key string, title string, url string, public boolean")


def is_public(path: Column) -> Column:
    return path.rlike(r"^/(signin|signup)(.*)$")


def eligible(path: Column) -> Column:
    """Paths for which a decision is made at all: no internals, no static files, always the API and the sign-in service."""
    return path.rlike(rf"^/((?!_next|[^?]*\.(?:{STATIC})).*)$") | path.rlike(ALWAYS[0]) | path.rlike(ALWAYS[1])


def decision(path: Column, signed_in: Column) -> Column:
    """redirect, protect or pass, in that order of rules; null where none is made."""
    into = signed_in & (is_public(path) | (path == "/"))
    return F.when(~eligible(path), None).when(into, "redirect:/chat").when(~is_public(path) & ~signed_in, "protect").otherwise("pass")


def landing(path: Column) -> Column:
    """The path that is served: the root leads to the sign-in page."""
    return F.when(path == "/", F.lit("/signin")).otherwise(path)


def route_map(key: str, value: str, rows=ROUTES) -> Column:
    """map<key, value> over the routes by two of key, title and url; of equal keys the last wins."""
    at = {"key": 0, "title": 1, "url": 2}
    pairs = {r[at[key]]: r[at[value]] for r in rows}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def merged(first: Column, then: Column) -> Column:
    """Both maps; where both have a key, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(then, k)), then)


def titles(requests: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """requests with the title of their path, null if unknown. The route table is a fixed few rows."""
    named = routes.select(F.col("url").alias("_url"), "title")
    return requests.join(F.broadcast(named), F.col(path) == F.col("_url"), "left").drop("_url")


def menu(requests: DataFrame, routes: DataFrame, path: str = "path", signed_in: str = "signed_in") -> DataFrame:
    """One row a request and visible entry: the open routes for guests, the others for members; active marks the path."""
    entries = routes.select("key", F.col("title").alias("entry"), "url", (~F.col("public")).alias("_for"))
    rows = requests.join(F.broadcast(entries), F.col("_for") == F.col(signed_in))
    return rows.withColumn("active", F.col("url") == F.col(path)).drop("_for")
