"""Functions that have no expression in Spark, run in Arrow batches: Markdown, JSON to XML, JSON paths."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions.jsonpath import compile_path
from strataframe.functions.scalars import singular_text
from strataframe.functions.xslt import stylesheet, transform


def _udf(f: Callable[[str], str | None]):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


# Markdown: paragraphs, headings, lists, quotes, code, emphasis, links and images

_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)"), r'<img src="\2" alt="\1" />', r"\1"),
    (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>', r"\1"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"<strong>\2</strong>", r"\2"),
    (re.compile(r"(\*|(?<!\w)_)(?=\S)(.+?)(?<=\S)\1"), r"<em>\2</em>", r"\2"),
)


def _inline(text: str, plain: bool) -> str:
    parts = re.split(r"`([^`]+)`", text)
    for i, part in enumerate(parts):
        if i % 2:
            parts[i] = part if plain else f"<code>{html.escape(part, False)}</code>"
        else:
            part = part if plain else html.escape(part, False)
            for pattern, tagged, bare in _INLINE:
                part = pattern.sub(bare if plain else tagged, part)
            parts[i] = part
    return "".join(parts)


def markdown(text: str, plain: bool = False) -> str:
    """HTML or plain text of a subset of Markdown."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n+", text.replace("\r\n", "\n").strip("\n")):
        lines = block.split("\n")
        if not block.strip():
            continue
        heading = re.match(r"(#{1,6})\s+(.*?)\s*#*$", lines[0])
        fence = re.match(r"(```|~~~)", lines[0])
        if fence:
            body = "\n".join(x for x in lines[1:] if not x.startswith(fence.group(1)))
            out.append(body + "\n" if plain else f"<pre><code>{html.escape(body, False)}\n</code></pre>\n")
        elif heading and len(lines) == 1:
            n, inner = len(heading.group(1)), _inline(heading.group(2), plain)
            out.append(inner + "\n" if plain else f"<h{n}>{inner}</h{n}>\n")
        elif all(re.match(r"\s*[-*+]\s+", x) for x in lines) or all(re.match(r"\s*\d+[.)]\s+", x) for x in lines):
            tag = "ul" if re.match(r"\s*[-*+]", lines[0]) else "ol"
            items = [_inline(re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", x), plain) for x in lines]
            out.append("\n".join(items) + "\n" if plain else f"<{tag}>\n" + "".join(f"<li>{x}</li>\n" for x in items) + f"</{tag}>\n")
        elif all(x.lstrip().startswith(">") for x in lines):
            inner = markdown("\n".join(re.sub(r"^\s*>\s?", "", x) for x in lines), plain)
            out.append(inner if plain else f"<blockquote>\n{inner}</blockquote>\n")
        else:
            inner = _inline("\n".join(x.strip() for x in lines), plain)
            out.append(inner + "\n" if plain else f"<p>{inner}</p>\n")
    return "".join(out)


def markdown_regions(text: str, open_: str | None, close: str | None, plain: bool = False) -> str:
    """text with the regions between marks converted, or all of it if there are none.

    A region that isn't closed ends at the next opening mark, which opens another, or at the end of the text.
    """
    if not open_ or not close:
        return markdown(text, plain)
    head, *regions = text.split(open_)
    out = [head]
    for r in regions:
        inside, found, rest = r.partition(close)
        out += [markdown(inside, plain), rest if found else ""]
    return "".join(out)


def markdown_filter(open_: str | None = None, close: str | None = None, plain: bool = False) -> Callable[[Column], Column]:
    return _udf(lambda x: markdown_regions(x, open_, close, plain) if x else x)


# JSON to XML


@dataclass(frozen=True)
class XmlOptions:
    """root: the root element. items: names of array items by array; others are in the singular of the array's name.

    numbered: items have their position as n. skip: `null`, `false` and `zero` values to leave out of objects.
    """

    root: str = "root"
    items: dict[str, str] = field(default_factory=dict)
    numbered: bool = False
    skip: frozenset[str] = frozenset()


def _skipped(v, o: XmlOptions) -> bool:
    if v is None:
        return "null" in o.skip
    if v is False:
        return "false" in o.skip
    return "zero" in o.skip and not isinstance(v, bool) and isinstance(v, (int, float, _Number)) and float(v) == 0


class _Number(str):
    """A number as it is written."""


def _element(name: str, v, o: XmlOptions, out: list[str], attr: str = "") -> None:
    if isinstance(v, list):
        item = o.items.get(name) or singular_text(name) or name
        out.append(f"<{name}{attr}>")
        for i, x in enumerate(v, 1):
            n = f' n="{i}"' if o.numbered else ""
            if isinstance(x, list):
                out.append(f"<{item}{n}>")
                _element(item, x, o, out)
                out.append(f"</{item}>")
            else:
                _element(item, x, o, out, n)
        out.append(f"</{name}>")
        return
    inner: list[str] = []
    if isinstance(v, dict):
        for k, x in v.items():
            if not _skipped(x, o):
                _element(k, x, o, inner)
    elif v is not None:
        inner.append(html.escape("true" if v is True else "false" if v is False else str(v), False))
    text = "".join(inner)
    out.append(f"<{name}{attr}>{text}</{name}>" if text else f"<{name}{attr} />")


def json_to_xml(text: str, o: XmlOptions = XmlOptions()) -> str | None:
    """XML of a JSON text; null if it can't be parsed. Numbers stay as they are written."""
    try:
        v = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []
    if isinstance(v, list):
        out.append(f"<{o.root}>")
        _element(o.root, v, o, out)
        out.append(f"</{o.root}>")
    else:
        _element(o.root, v, o, out)
    return "".join(out)


def json_to_xml_filter(o: XmlOptions = XmlOptions()) -> Callable[[Column], Column]:
    return _udf(lambda x: json_to_xml(x, o))


# JSON paths


def select_json(text: str, paths: tuple[str, ...], strip: bool = False) -> str | None:
    """JSON of what a chain of paths selects; strip: a text result comes without its quotes."""
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    for p in paths:
        v = compile_path(p)(v)
    return v if strip and isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def json_path_filter(*paths: str, strip: bool = False) -> Callable[[Column], Column]:
    for p in paths:
        compile_path(p)
    return _udf(lambda x: select_json(x, paths, strip))


def template_json(text: str, templates: dict[str, str], o: XmlOptions = XmlOptions()) -> str | None:
    """Text of a JSON value by one template per element name, in which `{.}` stands for what is inside it."""
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None

    def walk(name: str, v) -> str:
        if isinstance(v, dict):
            inner = "".join(walk(k, x) for k, x in v.items() if not _skipped(x, o))
        elif isinstance(v, list):
            inner = "".join(walk(o.items.get(name) or singular_text(name) or name, x) for x in v)
        else:
            inner = "" if v is None else html.escape("true" if v is True else "false" if v is False else str(v), False)
        return templates.get(name, "{.}").replace("{.}", inner)

    return walk(o.root, v)


def template_filter(templates: dict[str, str], o: XmlOptions = XmlOptions()) -> Callable[[Column], Column]:
    return _udf(lambda x: template_json(x, templates, o))


def xslt_filter(sheet: str, o: XmlOptions = XmlOptions(), paths: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """JSON by paths, then as XML, then by a stylesheet; a stylesheet that can't be read is an error at once."""
    stylesheet(sheet)

    def run(text: str) -> str | None:
        if paths:
            text = select_json('{"root":' + text + "}", paths)
        xml = None if text is None else json_to_xml(text, o)
        return None if xml is None else transform(xml, sheet)

    return _udf(run)
