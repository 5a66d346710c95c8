"""Plain versions of operators, row by row, to test against."""

import json
import re


def csv_record(raw):
    """Fields of one record, or None if its quoting is broken."""
    raw = raw[:-1] if raw.endswith("\r") else raw
    fields, i, n = [], 0, len(raw)
    while True:
        while i < n and raw[i] == " ":
            i += 1
        if i < n and raw[i] == '"':
            text, i = "", i + 1
            while True:
                if i >= n:
                    return None
                if raw[i] != '"':
                    text, i = text + raw[i], i + 1
                elif raw[i + 1 : i + 2] == '"':
                    text, i = text + '"', i + 2
                else:
                    i += 1
                    break
            while i < n and raw[i] == " ":
                i += 1
            if i < n and raw[i] != ",":
                return None
            fields.append(text)
        else:
            j = raw.find(",", i)
            j = n if j < 0 else j
            if '"' in raw[i:j]:
                return None
            fields.append(raw[i:j].rstrip(" "))
            i = j
        if i >= n:
            return fields
        i += 1


def quote_is_open(record):
    """Whether a record, character by character, ends within quotes."""
    state = "start"
    for c in record:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c in ", " else "plain"
        elif state == "plain":
            state = "start" if c == "," else "broken" if c == '"' else "plain"
        elif state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing":
            state = "quoted" if c == '"' else "start" if c == "," else "after" if c == " " else "broken"
        elif state == "after":
            state = "start" if c == "," else "after" if c == " " else "broken"
    return state == "quoted"


def split_sentences(text, marks, newline, trimming):
    """Character by character: a sentence ends after its last mark and the white space beyond, outside parentheses."""
    if not text:
        return text
    text = re.sub(r"\r?\n", " ", text)
    out, at, n = [], 0, len(text)
    while at < n:
        i = at
        while i < n and text[i] in marks:
            i += 1
        inside = False
        while i < n and (inside or text[i] not in marks):
            inside = text[i] != ")" if inside else text[i] == "("
            i += 1
        if i < n:
            while i < n and (text[i] in marks or text[i] in " \t\n\x0b\f\r"):
                i += 1
        out.append(text[at:i])
        at = i
    if trimming:
        out = [x for x in (re.sub(r"\A\s+|\s+\Z", "", s) for s in out) if x]
    return newline.join(out) + newline


def csv_failures(rows):
    files = {}
    for f, line, raw in sorted(set(rows)):
        files.setdefault(f, {})[line] = raw
    out = set()
    name = re.compile(r"[A-Za-z0-9._-]+")
    for f, lines in files.items():
        header = [x.lower() for x in csv_record(lines[1].lstrip("﻿"))]
        seen = False
        for line in sorted(lines):
            raw = lines[line]
            if line == 1 or raw is None or not raw.strip(" \r\n\t"):
                continue
            rec = csv_record(raw)
            if rec is None:
                out.add((f, line, "quoting"))
                continue
            if len(rec) != len(header):
                out.add((f, line, "columns"))
                continue
            r = dict(zip(header, rec, strict=True))
            t, i, v, g = (r.get(k, "") for k in ("thesaurusid", "id", "value", "targetid"))
            bad = not re.fullmatch(r"[A-Za-z0-9._-]+@[a-z]{2,3}", t) if t else not seen
            seen = seen or bool(t)
            bad = bad or (not i and not g) or (g and (i or v)) or (i and not name.fullmatch(i)) or (g and not re.fullmatch(r"[A-Za-z0-9._-]+(@[a-z]{2,3})?", g))
            bad = bad or any(c in "�\x7f" or (c < " " and c not in "\t\n\r") for c in v)
            if bad:
                out.add((f, line, "value"))
    return out


def _list(v):
    return v if isinstance(v, list) else [] if v is None else [v]


def children(docs, thesauri):
    out = set()
    for doc in docs:
        v = json.loads(doc)
        for item in _list(v["items"] if "items" in v else v):
            for i, part in enumerate(_list(item.get("_parts"))):
                if not isinstance(part, dict):
                    continue
                out.add(("part", item.get("_id"), i, part.get("_id")))
                content = part.get("content")
                content = json.loads(content) if isinstance(content, str) else content or {}
                frs = part["fragments"] if "fragments" in part else content.get("fragments")
                for j, fr in enumerate(_list(frs)):
                    if not isinstance(fr, dict):
                        continue
                    at = f"{part['_id']}/{j}"
                    out.add(("fragment", part["_id"], j, fr.get("location")))
                    for k, e in enumerate(_list(fr.get("entries"))):
                        if not isinstance(e, dict):
                            continue
                        out.add(("reading", at, k, e.get("value")))
                        for m, w in enumerate(_list(e.get("witnesses"))):
                            if isinstance(w, dict):
                                out.add(("witness", f"{at}/{k}", m, w.get("value")))
    for key, entries in thesauri:
        for i, e in enumerate(entries or []):
            if e is not None:
                out.add(("entry", key, i, e["id"]))
    return out
