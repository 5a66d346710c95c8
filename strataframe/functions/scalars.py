"""Text functions as columns, without Python workers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import codes

Filter = Callable[[Column], Column]


def chain(*filters: Filter) -> Filter:
    """One filter that applies several in turn."""
    return lambda c: reduce(lambda x, f: f(x), filters, c)


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")


def append(text: str) -> Filter:
    """Text at the end; null and empty values stay."""
    return lambda c: F.when(F.length(c) > 0, F.concat(c, F.lit(text))).otherwise(c)


def substitute(pattern: str, value: Callable[[Column], Column], group: int = 1) -> Filter:
    """Every match of pattern replaced by value of its group: the pieces between matches, joined with what replaces them."""
    def apply(c: Column) -> Column:
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), value)
        return F.array_join(F.zip_with(F.split(c, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return apply


def iso639(pattern: str = r"\^\^([a-z]{3})", letters: int = 3) -> Filter:
    """Language codes, as `^^eng`, to names; an unknown code stays without its mark."""
    table = lookup(codes.iso639(letters))
    return substitute(pattern, lambda k: F.coalesce(F.try_element_at(table, F.lower(k)), F.lower(k)))


def bcp47(pattern: str = r"\^\^([a-zA-Z]{2,3}(?:-[a-zA-Z0-9]+)*)", custom: dict[str, str] | None = None) -> Filter:
    """Language tags to names, first from custom ones, then the standard ones, else the tag; case doesn't matter."""
    table = lookup(codes.bcp47() | {k.lower(): v for k, v in (custom or {}).items()})
    return substitute(pattern, lambda k: F.coalesce(F.try_element_at(table, F.lower(k)), k))


def source_ids(mapping: dict[str, int], open_: str = "#[", close: str = "]#", omit: bool = False) -> Filter:
    """`#[map/key]#` to map and number; an unknown key stays, or is left out."""
    pattern = re.escape(open_) + r"([^\]\[]+?)" + re.escape(close)
    table = lookup({k: f"{k.split('/', 1)[0]}{v}" for k, v in mapping.items()})
    return substitute(pattern, lambda k: F.coalesce(F.try_element_at(table, k), F.lit("") if omit else k))


def replacements(rules: Sequence[tuple[str, str, bool]]) -> Filter:
    """Literal or (third value true) regular-expression replacements, in turn."""
    return lambda c: reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]) if r[2] else F.replace(x, F.lit(r[0]), F.lit(r[1])), rules, c)


#: fixed value: the marks that end a sentence, with the Greek question mark
MARKS = ".?!\u037e…"


def sentence_pattern(marks: str = MARKS, possessive: bool = True, openers: str = "(", closers: str = ")") -> str:
    """A sentence with its end marks and the space after them; what stands in parentheses isn't searched.

    possessive: for Java, whose engine else recurses once per parenthesis and runs out of stack on long texts.
    """
    m, o, c = ("".join("\\" + x if x in "\\]^-[&" else x for x in xs) for xs in (marks, openers, closers))
    if not openers or not closers:
        return rf"(?s)([{m}]*[^{m}]*(?:[{m}][{m}\s]*)?)"
    return rf"(?s)([{m}]*[^{m}{o}]*(?:[{o}][^{c}]*(?:[{c}]|$)[^{m}{o}]*)*{'+' if possessive else ''}(?:[{m}][{m}\s]*)?)"


def sentences(c: Column, marks: str = MARKS) -> Column:
    """The sentences of a text, without white space of any script around them, and without empty ones."""
    plain = F.replace(F.replace(c, F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    found = F.regexp_extract_all(plain, F.lit(sentence_pattern(marks)), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")), lambda s: s != "")


def split_sentences(marks: str = MARKS, newline: str = "\n", openers: str = "(", closers: str = ")", trimming: bool = True, line_ends: bool = False) -> Filter:
    """One sentence a line, with a line end after the last; null and empty values stay.

    What stands between openers and closers isn't searched for marks. trimming: no white space around the line ends put in.
    line_ends: those of the text stay, else they become spaces.
    """
    def apply(c: Column) -> Column:
        plain = c if line_ends else F.regexp_replace(c, r"\r?\n", " ")
        found = F.filter(F.regexp_extract_all(plain, F.lit(sentence_pattern(marks, True, openers, closers)), F.lit(1)), lambda s: s != "")
        if trimming:
            found = F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")), lambda s: s != "")
        return F.when(F.length(c) > 0, F.concat(F.array_join(found, newline), F.lit(newline))).otherwise(c)

    return apply


def cut_text(c: Column, max_length: int = 80, minus: int = 5, plus: int = 5, percents: bool = False, stops: str = " .,;:!?", ellipsis: str = "...") -> Column:
    """A text no longer than about max_length: cut after the last stop character from minus before to plus after it.

    Where there is none it is cut at max_length. percents: minus and plus are shares of it. Short texts stay.
    """
    minus, plus = (max_length * x // 100 if percents else x for x in (minus, plus))
    head = F.substr(c, F.lit(1), F.lit(max_length + plus))
    at = F.length(F.regexp_extract(head, rf"(?s)\A(.{{{max(0, max_length - minus)},}})[{re.escape(stops)}]", 1))
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(F.when(at > 0, F.substr(c, F.lit(1), at)).otherwise(F.substr(c, F.lit(1), F.lit(max_length))), F.lit(ellipsis)))


#: fixed values: plurals that follow no rule
IRREGULAR = {
    "children": "child", "people": "person", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "oxen": "ox", "criteria": "criterion", "phenomena": "phenomenon", "data": "datum", "analyses": "analysis",
    "bases": "basis", "crises": "crisis", "theses": "thesis", "vertices": "vertex", "indices": "index", "matrices": "matrix", "appendices": "appendix",
}
#: fixed values: endings, the letters each must follow, what is cut and what is put there
ENDINGS = (("ies", 3, 3, "y"), ("ves", 3, 3, "f"), ("oes", 3, 2, ""), ("ses", 3, 2, ""), ("xes", 3, 2, ""), ("ches", 4, 2, ""), ("shes", 4, 2, ""))


def singular(c: Column) -> Column:
    """The singular of an English plural; null for blank text and for what is no plural."""
    low = F.lower(c)
    out = F.when(low.endswith("s") & ~low.endswith("ss") & (F.length(c) > 1), F.left(c, F.length(c) - 1))
    for ending, longer, cut, put in reversed(ENDINGS):
        out = F.when(low.endswith(ending) & (F.length(c) > longer), F.concat(F.left(c, F.length(c) - cut), F.lit(put))).otherwise(out)
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(F.coalesce(F.try_element_at(lookup(IRREGULAR), low), out))


def singular_text(text: str) -> str | None:
    """singular() of one Python string."""
    if not text.strip():
        return None
    low = text.lower()
    if low in IRREGULAR:
        return IRREGULAR[low]
    for ending, longer, cut, put in ENDINGS:
        if low.endswith(ending) and len(text) > longer:
            return text[:-cut] + put
    return text[:-1] if low.endswith("s") and not low.endswith("ss") and len(text) > 1 else None


def file_name(c: Column, put: str = "_") -> Column:
    """A name that is safe for files: characters not allowed are replaced, trailing dots and spaces cut."""
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', put), r"[. ]+\z", "")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """`{name}` replaced by the value of name; unknown names stay, null values are empty."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))


def strip_quotes(c: Column) -> Column:
    return F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)


# features: ARRAY<STRUCT<name, value>>, in which a name may recur

FEATURES = "array<struct<name:string,value:string>>"


def feature(name: str, value: Column | str) -> Column:
    return F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))


def add_feature(features: Column, name: str, value: Column | str, unique: bool = False) -> Column:
    """features with one more, unless it is there; unique: instead of others of its name."""
    kept = F.filter(features, lambda f: f["name"] != name) if unique else features
    return F.array_union(F.coalesce(kept, F.array().cast(FEATURES)), F.array(feature(name, value)))


def remove_features(features: Column, name: str | None = None, value: str | None = None) -> Column:
    """features without those of a name, and a value; without all if no name is given."""
    if name is None:
        return F.array().cast(FEATURES)
    return F.filter(features, lambda f: ~((f["name"] == name) & (F.lit(True) if value is None else f["value"].eqNullSafe(F.lit(value)))))


def has_feature(features: Column, name: str, value: str | None = None) -> Column:
    return F.coalesce(F.exists(features, lambda f: (f["name"] == name) & (F.lit(True) if value is None else f["value"].eqNullSafe(F.lit(value)))), F.lit(False))


def decorate_fragments(fragments: Column, type_id: Column, role_id: Column) -> Column:
    """Fragments (JSON objects as text) each with a _key: type:role@index."""
    key = lambda i: F.concat(type_id, F.coalesce(F.concat(F.lit(":"), role_id), F.lit("")), F.lit("@"), i.cast("string"))
    return F.transform(fragments, lambda x, i: F.concat(F.lit('{"_key":"'), key(i), F.lit('"'), F.when(F.regexp_like(x, F.lit(r"\A\s*\{\s*\}\s*\z")), F.lit("}")).otherwise(F.concat(F.lit(","), F.regexp_replace(x, r"\A\s*\{", "")))))


def decorate_part(content: Column) -> Column:
    """A layer part's JSON with a _key in each of its fragments, of its own typeId and roleId; other JSON stays."""
    fragments = F.from_json(F.get_json_object(content, "$.fragments"), "array<string>")
    keyed = decorate_fragments(fragments, F.coalesce(F.get_json_object(content, "$.typeId"), F.lit("")), F.get_json_object(content, "$.roleId"))
    member = lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.coalesce(e["value"], F.lit("null")))
    return F.when(fragments.isNull(), content).otherwise(F.concat(F.lit("{"), F.array_join(F.concat(F.transform(F.map_entries(raw_members(content)), member), F.array(F.concat(F.lit('"fragments":['), F.array_join(keyed, ","), F.lit("]")))), ","), F.lit("}")))


def raw_members(content: Column) -> Column:
    """The members of a JSON object but fragments, each with its JSON text."""
    v = F.try_parse_json(content)
    members = F.try_variant_get(v, "$", "map<string,variant>")
    return F.transform_values(F.map_filter(members, lambda k, _: k != "fragments"), lambda _, x: F.to_json(x))


def fragment_at(content: Column, index: int) -> Column:
    """The fragment of a part's JSON content at a position, as JSON; null if there is none."""
    return F.get_json_object(content, f"$.fragments[{index}]")


def thesaurus_references(df: DataFrame, key: str, text: str, entries: DataFrame, pattern: str = r"\$([@_a-zA-Z0-9.-]+):([_a-zA-Z0-9.-]+)") -> DataFrame:
    """(key, text) with `$thesaurus:entry` replaced by the entry's value, or by the entry's id where there is none.

    entries: (thesaurus_id, id, value). The references of all rows are joined at once, then put back in their places.
    Rows with a null key are kept; rows are told apart by a number, so repeated keys do no harm.
    """
    rows = df.select(F.monotonically_increasing_id().alias("__n"), F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    refs = rows.where(F.regexp_like("__text", F.lit(pattern))).select("__n", F.posexplode(F.arrays_zip(F.regexp_extract_all("__text", F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all("__text", F.lit(pattern), F.lit(2)).alias("e"))).alias("i", "r")).select("__n", "i", "r.t", "r.e")
    known = entries.groupBy(F.col("thesaurus_id").alias("kt"), F.col("id").alias("ke")).agg(F.min("value").alias("v"))
    found = refs.join(known, (F.col("t") == F.col("kt")) & (F.col("e") == F.col("ke")), "left").select("__n", "i", F.coalesce("v", "e").alias("v"))
    values = found.groupBy("__n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vs"))
    pieces = F.zip_with(F.split("__text", pattern, -1), F.coalesce("vs", F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return rows.join(values, "__n", "left").select(F.col("__key").alias(key), F.when(F.col("__text").isNotNull(), F.array_join(pieces, "")).alias(text))
