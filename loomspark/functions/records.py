"""The user, layer and id of a record, whatever form they come in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Spellings that stand for nobody, after lower case and without separators and white space.
NOBODY = ("", "0", "null", "none", "nil", "nan", "na", "n/a", "unknown", "anonymous", "anon", "guest", "undefined", "nobody", "test", "?")


def canonical_user(user: Column) -> Column:
    """One spelling for each user; null where the value is null or stands for nobody.

    Case, surrounding and inner white space, invisible characters, hyphens and underscores don't distinguish users.
    """
    key = F.lower(F.regexp_replace(user, r"[\s\x{00a0}\x{200b}-\x{200d}\x{2060}\x{3000}\x{feff}_\-]+", ""))
    return F.when(~key.isin(*NOBODY), key)


def effective_layer(source_layer: Column, file_layer: Column) -> Column:
    return F.coalesce(F.nullif(source_layer, F.lit("")), file_layer)


def effective_id(id_: Column, layer: Column, prompt_hash: Column) -> Column:
    """The id, or ``layer:prompt_hash`` for a null or empty one; null if that can't be made either."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.concat(layer, F.lit(":"), prompt_hash))
