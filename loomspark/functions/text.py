"""Scalar functions on text, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the white space that separates words, as in Python's str.split.
WHITESPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = rf"[^{WHITESPACE}]+"

# Fixed values of the chat template.
TURN, END_OF_TURN = "<|turn>", "<turn|>\n"
LOSS_PREFIX = "<|channel>thought\n<channel|>"
HEADERS = {"user": "user", "assistant": "model", "system": "system"}


#: The same for ASCII texts, which a regular expression goes through several times as fast.
ASCII_WORD = r"[^\t-\r\x1c-\x20]+"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def words(text: Column) -> Column:
    """The words of a text; an empty array for a null or empty one."""
    found = F.when(_ascii(text), F.regexp_extract_all(text, F.lit(ASCII_WORD), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.when(_ascii(text), F.regexp_count(text, F.lit(ASCII_WORD))).otherwise(F.regexp_count(text, F.lit(WORD))), F.lit(0))


def word_id(word: Column) -> Column:
    """Stand-in token id of a word: 28 bits of its MD5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 7), 16, 10).cast("int")


def role_bucket(role: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant"), role).otherwise("other")


def shuffle_key(id_: Column, seed: int) -> Column:
    """A reproducible random key: the same in any engine and partitioning."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")).cast("binary"))


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def layer_of_file(name: Column) -> Column:
    """``<layer>_regen.jsonl`` -> layer; also of a file that is one of several, ``<layer>_regen-00001.jsonl``."""
    return F.regexp_replace(F.regexp_replace(name, r"(?:-\d{5})?\.jsonl$", ""), r"_regen$", "")


def error_path(path: Column) -> Column:
    """Where the failed rows of an output go: ``x.jsonl`` -> ``x_error.jsonl``."""
    return F.regexp_replace(path, r"\.jsonl$", "_error.jsonl")


def rendered_content(role: Column, content: Column) -> Column:
    """Assistant contents begin with the loss prefix, once."""
    return F.when((role == "assistant") & ~content.startswith(LOSS_PREFIX), F.concat(F.lit(LOSS_PREFIX), content)).otherwise(content)


def render(messages: Column) -> Column:
    """One string of all turns. Null where an assistant content is missing or a role has no header (the row is skipped)."""
    header = F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv])
    turn = F.transform(
        messages,
        lambda m: F.concat(F.lit(TURN), header[m["role"]], F.lit("\n"), rendered_content(m["role"], F.when(m["role"] == "assistant", m["content"]).otherwise(F.coalesce(m["content"], F.lit("")))), F.lit(END_OF_TURN)),
    )
    return F.when(~F.exists(turn, lambda t: t.isNull()), F.array_join(turn, ""))


SPAN = r"(?d)<\|turn>model\n((?:<\|channel>thought\n<channel\|>)?[\s\S]*?(?:<turn\|>\n|$))"


def assistant_spans(text: Column) -> Column:
    """The supervised parts of a rendered text: each model turn after its loss prefix, with its end-of-turn marker."""
    found = F.regexp_extract_all(text, F.lit(SPAN), F.lit(1))
    return F.transform(found, lambda s: F.when(s.startswith(LOSS_PREFIX), F.substring(s, len(LOSS_PREFIX) + 1, 1 << 30)).otherwise(s))
