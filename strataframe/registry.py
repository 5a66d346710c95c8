"""Components by tag and their options, as a JSON configuration names them.

A tag may carry a vendor prefix of two names, which doesn't count: `a.b.text-filter.str.appender` is
`text-filter.str.appender`.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from strataframe.functions import arrow, scalars
from strataframe.functions.predicates import FrameFilter
from strataframe.operators import framing, render, texts
from strataframe.sources import readers, sinks

#: fixed values: the kinds of components, as they start a tag
KINDS = ("entry-set-context-patcher", "entry-set-context", "entry-set-exporter", "item-composer", "item-id-collector", "json-renderer", "renderer-context-supplier", "rendering-factory-provider", "text-filter", "text-flattener", "text-tree-filter", "text-tree-renderer")

COMPONENTS: dict[str, Callable] = {}


def component(tag: str):
    """Registers a factory, called with a component's options."""
    def add(f: Callable) -> Callable:
        COMPONENTS[tag] = f
        return f

    return add


def normal(tag: str) -> str:
    parts = tag.split(".")
    for i in range(len(parts)):
        if parts[i] in KINDS:
            return ".".join(parts[i:])
    return tag


def create(tag: str, options: dict | None = None):
    """The component of a tag, or of the longest beginning of it that is known; KeyError for an unknown one."""
    name = normal(tag)
    while name not in COMPONENTS and "." in name:
        name = name.rpartition(".")[0]
    return COMPONENTS[name](**{k[:1].lower() + k[1:]: v for k, v in (options or {}).items()})


# Options that a component doesn't know raise TypeError. connectionString, databaseName and outputDirectory are known and
# have no effect here: tables come as DataFrames, and callers say where output goes.

component("text-filter.str.appender")(lambda text="": scalars.append(text))
component("text-filter.str.iso639")(lambda pattern=r"\^\^([a-z]{3})", twoLetters=False: scalars.iso639(pattern, 2 if twoLetters else 3))
component("text-filter.str.bcp47")(lambda pattern=None, customTagNames=None: scalars.bcp47(**({"pattern": pattern} if pattern else {}), custom=customTagNames))
component("text-filter.str.markdown")(lambda markdownOpen=None, markdownClose=None, format="html": arrow.markdown_filter(markdownOpen, markdownClose, format == "txt"))
component("text-filter.str.source-id")(lambda mapping=None, tagOpen="#[", tagClose="]#", omitUnresolved=False: scalars.source_ids(mapping or {}, tagOpen, tagClose, omitUnresolved))
component("text-filter.str.mongo-thesaurus")(lambda pattern=None, connectionString=None: lambda df, key, text, entries: scalars.thesaurus_references(df, key, text, entries, **({"pattern": pattern} if pattern else {})))


@component("text-filter.str.sentence-split")
def _sentences(endMarkers=None, blackOpeners=None, blackClosers=None, newLine="\n", trimming=False, crLfRemoval=False):
    return scalars.split_sentences(endMarkers or scalars.MARKS, newLine, blackOpeners or "(", blackClosers or ")", trimming, not crLfRemoval)


@component("text-filter.str.mongo-token-extractor")
def _tokens(connectionString=None, locationPattern=r"@\{([^}]+)\}", textTemplate=None, wholeToken=False, startMarker="[", endMarker="]", textCutting=False, maxLength=80, limitAsPercents=False, minusLimit=5, plusLimit=5, stopChars=" .,;:!?", ellipsis="..."):
    cut = {"max_length": maxLength, "minus": minusLimit, "plus": plusLimit, "percents": limitAsPercents, "stops": stopChars, "ellipsis": ellipsis} if textCutting else None
    return lambda df, base: texts.extract_tokens(df, base, locationPattern, textTemplate or "{text}", startMarker or "", endMarker or "", portion=not wholeToken, cut=cut)


component("json-renderer.null")(lambda: lambda c: c)


@component("json-renderer.xslt")
def _xslt(xslt=None, jsonExpressions=(), quoteStripping=False, frDecoration=False, wrappedEntryNames=None, templates=None, arrayItemNumbering=False, rootElementName="root", noNullValues=False, noFalseValues=False, noZeroValues=False, filterKeys=(), namespaces=None, defaultNsPrefix=None):
    skip = frozenset(k for k, on in (("null", noNullValues), ("false", noFalseValues), ("zero", noZeroValues)) if on)
    options = arrow.XmlOptions(rootElementName, items=wrappedEntryNames or {}, numbered=arrayItemNumbering, skip=skip)
    if xslt:
        f = arrow.xslt_filter(xslt, options, tuple(jsonExpressions))
    elif templates:
        f = arrow.template_filter(templates, options)
    elif jsonExpressions:
        f = arrow.json_path_filter(*jsonExpressions, strip=quoteStripping)
    else:
        f = (lambda c: c) if frDecoration else arrow.json_to_xml_filter(options)
    return (lambda c, type_id=None, role_id=None: f(scalars.decorate_part(c))) if frDecoration else f


component("json-renderer.tei-off.apparatus")(lambda zeroVariantType=None, noNAttribute=False, witDetailAsChild=False: lambda segments, entries: render.apparatus(segments, entries, not noNAttribute, zeroVariantType, True, witDetailAsChild))
component("text-flattener.token")(lambda: texts.flatten)
component("text-tree-filter.block-linear")(lambda: lambda df, keys=("item_id",): texts.block_lines(df, keys))


@component("text-tree-filter.merge-linear")
def _merge(features=(), valueFilters=(), breakAtLF=True):
    rules = [(r["find"], r["replace"], bool(r.get("isRegex"))) for r in ({k[:1].lower() + k[1:]: v for k, v in f.items()} for f in valueFilters or ())]
    return lambda df, keys=("item_id",): texts.merge_linear(df, tuple(features or ()), breakAtLF, keys, rules)


component("text-tree-filter.composite")(lambda filter=None, keys=("item_id", "sub_id"): lambda df, _keys=None: create(filter["id"], filter.get("options"))(df, tuple(keys)) if filter else df)
component("text-tree-filter.app-parallel")(lambda witReplacements=None, authReplacements=None, sortSources=False: lambda segments, entries: texts.version_tree(texts.versions(segments, texts.renamed_sources(entries, witReplacements, authReplacements))))


def _blocks(rootElement="tei:div", isRootIncluded=False, blockElements=None, isIndented=False, noItemSource=False, noNAttribute=False, namespaces=None, defaultNsPrefix="tei", blockType="default"):
    """Options of XML renderers; defaultNsPrefix goes to names without a prefix, namespaces are `prefix=uri` or a map."""
    spaces = dict(n.split("=", 1) for n in namespaces) if isinstance(namespaces, (list, tuple)) else dict(namespaces or {})
    full = lambda n: n if ":" in n or not defaultNsPrefix else f"{defaultNsPrefix}:{n}"
    elements = {"default": "tei:p"} | (blockElements or {})
    return render.Blocks(full(rootElement), isRootIncluded, {k: full(v) for k, v in elements.items()}, blockType, isIndented, not noItemSource, not noNAttribute, spaces)


def _with_group(f: Callable, head: str | None, tail: str | None) -> Callable:
    """f, with the texts that a composer puts around each group of what it renders."""
    f.group = {"group_head": head or "", "group_tail": tail or ""}
    return f


component("text-tree-renderer.payload-linear")(lambda flattenLines=False: lambda pieces: render.payload_lines(pieces, flattenLines))
component("text-tree-renderer.tei-off-linear")(lambda groupHeadTemplate=None, groupTailTemplate=None, **blocks: (lambda o: _with_group(lambda pieces: render.tei_standoff(pieces, o), groupHeadTemplate, groupTailTemplate))(_blocks(**blocks)))


@component("text-tree-renderer.tei-app-linear")
def _app_linear(zeroVariantType=None, witDetailAsChild=False, groupHeadTemplate=None, groupTailTemplate=None, **blocks):
    o = _blocks(**blocks)
    return _with_group(lambda pieces, segments, entries: render.tei_apparatus(pieces, render.apparatus(segments, entries, o.number, zeroVariantType, False, witDetailAsChild), o), groupHeadTemplate, groupTailTemplate)


component("text-tree-renderer.tei-app-parallel")(lambda noItemSource=True, noNAttribute=False, groupHeadTemplate=None, groupTailTemplate=None: _with_group(lambda tree: render.tei_parallel(tree, not noItemSource, not noNAttribute), groupHeadTemplate, groupTailTemplate))
component("text-tree-renderer.composite")(lambda renderers=(): render.composite(*[create(r["id"], r.get("options")) for r in renderers]))
component("renderer-context-supplier.flag")(lambda on=None, off=None: lambda df, column="flags": framing.flag_metadata(df, column, on or {}, off or {}))


@component("item-id-collector.mongo")
def _collector(connectionString=None, pageNumber=0, pageSize=0, title=None, description=None, facetId=None, groupId=None, flags=None, flagMatching="all_set", userId=None, minModified=None, maxModified=None):
    how = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", flagMatching.removeprefix("bits") if isinstance(flagMatching, str) else "all_set").lower()
    own = FrameFilter(title, description, facetId, groupId, userId, flags, how, minModified, maxModified)
    return lambda items, f=own: readers.item_ids(items, f)


@component("item-composer.txt.fs")
def _plain_composer(textHead="", textTail="", itemHead="", itemTail="", itemGrouping=False, outputDirectory=None):
    return lambda items, rendered, **group: render.composed(items, rendered, textHead, textTail, item_head=itemHead, item_tail=itemTail, grouped=itemGrouping, **group)


component("item-composer.tei.fs")(lambda textHead="", textTail="", outputDirectory=None: lambda items, rendered, **group: render.composed(items, rendered, textHead, textTail, **group))


@component("item-composer.tei-standoff.fs")
def _standoff_composer(textHead="", textTail="", layerHead="", layerTail="", outputDirectory=None):
    """The base text has its own head and tail, every layer's flow those of layers."""
    return lambda items, **flows: {k: render.composed(items, v, *((textHead, textTail) if k in ("base", "base-text") else (layerHead, layerTail))) for k, v in flows.items()}


component("entry-set-context-patcher")(lambda: framing.items_patched)
component("entry-set-context")(lambda: framing.ensure_parts)
component("entry-set-exporter")(lambda noHistory=False, connectionString=None: lambda items, parts, path: sinks.append_import(items, parts, path, not noHistory))
component("entry-set-exporter.md-dump")(lambda maxEntriesPerDumpFile=100, noEntries=False, jsonParts=False, outputDirectory=None: lambda items, parts=None: sinks.markdown_items(items, maxEntriesPerDumpFile, parts, jsonParts))
component("rendering-factory-provider.standard")(lambda: Configuration)


@dataclass
class Configuration:
    """Sections of components: section → list of {keys, id, options}; a disabled component is skipped."""

    sections: dict[str, list[dict]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Configuration:
        sections = {k[:1].lower() + k[1:]: [{a[:1].lower() + a[1:]: b for a, b in c.items()} for c in v] for k, v in json.loads(text).items() if isinstance(v, list)}
        return cls(sections)

    def keys(self, section: str) -> list[str]:
        return [k for c in self.sections.get(section, []) for k in str(c.get("keys", "")).split()]

    def get(self, section: str, key: str):
        """The component with a key in a section, or None."""
        for c in self.sections.get(section, []):
            options = {k[:1].lower() + k[1:]: v for k, v in (c.get("options") or {}).items()}
            if key in str(c.get("keys", "")).split() and not options.pop("isDisabled", False):
                return create(c["id"], options)
        return None

    def entry(self, section: str, key: str) -> dict | None:
        """The options of a component as they stand, or None."""
        for c in self.sections.get(section, []):
            if key in str(c.get("keys", "")).split():
                return {k[:1].lower() + k[1:]: v for k, v in (c.get("options") or {}).items()}
        return None

    def compose(self, key: str, items, parts):
        """(flow, item_nr, text) of items by the composer of a key: its flattener, tree filters and renderer, by their keys.

        KeyError for a composer or a component that isn't there.
        """
        own = self.entry("itemComposers", key)
        if own is None:
            raise KeyError(key)
        refs = {k: own.pop(k, None) for k in ("textPartFlattenerKey", "textTreeFilterKeys", "textTreeRendererKey", "jsonRendererKeys", "contextSupplierKeys")}
        composer = create(next(c["id"] for c in self.sections["itemComposers"] if key in str(c.get("keys", "")).split()), own)

        def named(section: str, k: str):
            found = self.get(section, k)
            if found is None:
                raise KeyError(f"{section}: {k}")
            return found

        for k in refs["contextSupplierKeys"] or []:
            items = named("rendererContextSuppliers", k)(items)
        if refs["textPartFlattenerKey"]:
            named("textPartFlatteners", refs["textPartFlattenerKey"])
        base, fragments, segments = texts.layered(parts)
        entries = texts.apparatus_entries(fragments)
        pieces, tree = None, None
        for k in refs["textTreeFilterKeys"] or []:
            tag = normal(next(c["id"] for c in self.sections["textTreeFilters"] if k in str(c.get("keys", "")).split()))
            f = named("textTreeFilters", k)
            if tag.endswith("app-parallel"):
                tree = f(segments, entries)
            elif tag.endswith("block-linear"):
                pieces = f(segments)
            else:
                segments = f(segments.withColumn("features", texts.fragment_features()))
        pieces = texts.with_lines(pieces if pieces is not None else texts.block_lines(segments))
        if not refs["textTreeRendererKey"]:
            return composer(items, base.select("item_id", "text"))
        renderer = named("textTreeRenderers", refs["textTreeRendererKey"])
        tag = normal(next(c["id"] for c in self.sections["textTreeRenderers"] if refs["textTreeRendererKey"] in str(c.get("keys", "")).split()))
        if tag.endswith("tei-app-parallel"):
            made = renderer(tree if tree is not None else texts.version_tree(texts.versions(segments, entries)))
        else:
            made = renderer(pieces, segments, entries) if tag.endswith("tei-app-linear") else renderer(pieces)
        return composer(items, made, **getattr(renderer, "group", {}))

    def chain(self, keys: list[str], section: str = "textFilters"):
        """The text filters of keys, in turn."""
        return scalars.chain(*[f for f in (self.get(section, k) for k in keys) if f is not None])


def plugin(name: str) -> None:
    """Load a module that registers components of its own."""
    importlib.import_module(name)
