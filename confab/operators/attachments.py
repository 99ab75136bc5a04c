"""Lists of attachments, as arrays of structs in order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def append(held: Column, new: Column) -> Column:
    """Held ones, then the new ones; null lists are empty."""
    return F.when(held.isNull(), new).when(new.isNull(), held).otherwise(F.concat(held, new))


def remove(held: Column, id_: Column) -> Column:
    """All but those with the id."""
    return F.filter(held, lambda x: x["id"] != id_)


def clear(held: Column) -> Column:
    return F.filter(held, lambda x: F.lit(False))


def pop_last(held: Column, text: Column) -> Column:
    """Without the last one if the text is empty; an empty list stays."""
    return F.when((F.coalesce(text, F.lit("")) == "") & (F.size(held) > 0), F.slice(held, 1, F.size(held) - 1)).otherwise(held)


def without_ids(held: Column) -> Column:
    return F.transform(held, lambda x: x.dropFields("id"))


def data_url(content: Column, media_type: Column) -> Column:
    """The content itself as a URL; null content gives null."""
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.replace(F.replace(F.base64(content), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))


def with_ids(new: Column) -> Column:
    """New ones with a random id each; not repeatable, so store the result before it is read twice."""
    return F.transform(new, lambda x: x.withField("id", F.uuid()))


def pasted(items: Column) -> Column:
    """Of clipboard items those of kind ``file``."""
    return F.filter(items, lambda x: x["kind"] == "file")
