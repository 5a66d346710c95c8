"""Template residue and error-page text in place of content.

A multi-pattern automaton runs over the words of a text, without case, accents, digits and punctuation, so odd spaces,
line breaks and entities hide nothing. Its patterns are the short general phrases of `phrases`, in five languages. A text
in which no core phrase or filler occurs is let go. Others are cut into lines and sentences, and short ones are also taken
whole: a unit in which a core phrase stands, and of whose letters the phrases cover at least a given share, is residue.
Words that say nothing count neither way. So a sentence that only speaks of an error, which has words of its own, isn't.

Unfilled placeholders are proposed by a second automaton and told by their brackets and what these hold; those that a text
quotes or speaks of don't count. Filler also shows by the same word or characters again and again.
"""

from __future__ import annotations

import html
import operator
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from strataframe.llm import phrases

#: the share of a unit's letters that phrases must cover
SHARE = 0.75
#: characters up to which a text is also taken as one unit
WHOLE = 600
#: fixed values: fields of a record that templates have placeholders for
FIELDS = r"(?:title|abstract|summary|description|claims?|claim[ _]?\d+(?:[ _]?text)?|component|effect|inventors?|applicants?|applicant[ _]?name|filing[ _]?date|pub(?:lication)?[ _]?no|ipc(?:[ _]?main)?|drawing[ _]?refs?|field|background|priority[ _]?date|agent|keywords?)"
_STRICT = rf"""
    \{{\{{[#/]?\s*[A-Za-z_][\w.-]*(?:\s+[A-Za-z_][\w.-]*)?(?:\s*\|\s*\w+)*\s*\}}\}}
  | \{{\s*{FIELDS}\s*\}}
  | %\({FIELDS}\)[sd]
  | \[\s*(?:your|enter|add|type|put|replace|click|write|bitte|votre|saisi\w*|ins[ée]r\w*|indiqu\w*)\s+[^\[\]\n]{{1,60}}\]
  | <\s*(?:your|enter|add|type|put|replace|click|write|bitte|votre|saisi\w*|ins[ée]r\w*|indiqu\w*)\s+[^<>=\n]{{1,60}}>
  | \[\s*[^\[\]\n]{{1,40}}\s+(?:here|hier\s+eingeben|eintragen|einfügen|einsetzen|eingeben|ergänzen|à\s+compléter|à\s+insérer|à\s+remplir)\s*\]
  | [【\[［]\s*[^\n】\]］]{{1,12}}を(?:入力|記入|入れる)\s*[】\]］]
  | \{{\{{\s*(?:doc\.)?{FIELDS}\b
  | <%=?\s*[A-Za-z_][\w. ]*%>
  | \#\{{\s*{FIELDS}\s*\}}
  | \$\{{\s*{FIELDS}\s*\}}
  | \{{%-?\s*{FIELDS}\s*-?%\}}
  | \$\$\[\s*{FIELDS}\s*\]
  | \$\(\s*{FIELDS}\s*\)
  | @@{FIELDS}@@
  | \[\[\s*{FIELDS}\s*\]\]
  | __{FIELDS}__
  | %{FIELDS}%
  | ~{FIELDS}~
  | <<\s*{FIELDS}\s*>>
  | «{FIELDS}»
  | <\s*placeholder[ _]?\d*\s*>
  | <\s*todo\s*:[^<>\n]{{1,60}}>
  | <\s*insert\s+[^<>\n]{{1,60}}>
  | \[\s*insert\s+[^\[\]\n]{{1,60}}\]
  | \[\s*{FIELDS}\s*\]
  | \bXXX\s+{FIELDS}\s+XXX\b
  | (?<![\w"„“«])\b{FIELDS}\s+goes\s+here\b
  | \[\s*Hier\s+[^\[\]\n]{{1,40}}\]
  | <\s*[^<>\n]{{1,40}}\s+(?:eintragen|einfügen|einsetzen|à\s+compléter|à\s+insérer|à\s+remplir)\s*>
  | \[\s*(?:Ins[ée]rer|Indiquer|Saisir)\s+[^\[\]\n]{{1,50}}\]
  | \(\s*(?:Platzhalter|Espace\s+réservé)\s+[^()\n]{{1,40}}\)
  | ×{{4,}} | ○{{4,}} | 〇{{4,}} | ●{{4,}} | ＊{{4,}}
  | [（(【\[<［]\s*待(?:补充|填写|定)\s*[）)】\]>］]
  | \(\s*(?:texte|titre|résumé)\s+d[eu]\b[^()\n]{{1,30}}\) | \(\s*(?:Text|Titel)\s+de[rs]\s+[^()\n]{{1,30}}\)
  | [（(【\[<]\s*(?:此处|在此|请(?:输入|填写|在此))[^\n）)】\]>]{{0,20}}[）)】\]>]
  | [（(【\[<]?[^\n（(【\[<）)】\]>。、]{{0,12}}[）)】\]>]?を?ここに(?:記載|入力|記入)
  | [（(【\[<]\s*ここに[^\n）)】\]>]{{1,20}}[）)】\]>]
"""
PLACEHOLDER = re.compile(_STRICT, re.X | re.I)
_STEMS = ("title", "abstract", "summary", "description", "claim", "component", "effect", "inventor", "applicant", "filing", "pub", "ipc", "drawing", "field", "background", "priority", "agent", "keyword")
#: what every form of placeholder contains, in lower case and without white space
HINTS = [
    "{{", "%(", "[your", "<your", "[enter", "<enter", "[add", "<add", "[type", "<type", "[put", "<put", "[replace", "<replace", "[click", "<click", "[write", "<write", "[bitte", "<bitte", "[votre", "<votre", "[saisi", "<saisi", "<insér", "<inser", "[indiqu", "<indiqu", "here]", "eingeben]", "ergänzen]", "を入力", "を記入", "を入れる",
    "<%", "$" + "{", "#{", "{%", "$$[", "$(", "@@", "[[", "goeshere", "<placeholder", "<todo", "<insert", "[insert", "[hier", "eintragen", "einfügen", "einsetzen", "àcompléter", "àinsérer", "àremplir",
    "[insér", "[inser", "[indiquer", "[saisir", "(platzhalter", "(espace", "(texted", "(titred", "(résuméd", "(textde", "(titelde", "此处", "在此", "请输入", "请填写", "ここに", "待补充", "待填写", "待定", "××××", "○○○○", "〇〇〇〇", "●●●●", "＊＊＊＊",
    *[f"{w}{s}" for w in ("__", "%", "~", "<<", "«", "[", "{", "xxx") for s in _STEMS],
]
#: letters that expressions without case take for s and i, and the dot that the lower case of a dotted I leaves
_SAME = (("ſ", "s"), ("ı", "i"), ("\u0307", ""))
_QUOTES = "\"'“”„‟«»「」『』‘’`"
#: fixed values: words after which a bracketed name is spoken of
_MENTION = re.compile(r"(?:\b(?:fie[l1]d|tag|variable|string|pattern|patterns|placeholder|marker|element|key|macro|token|feld|muster|zeichenfolge|platzhalter|kennung|champ|balise|chaîne|motif|étiquette)|字段|变量|标签|字符串|変数|タグ|項目|文字列)\s*$", re.I)
_MENTIONED = re.compile(r"(?:of\s+(?:[-–—]\s*\d+\s*[-–—]\s*)?the\s+record|is\s+replaced|are\s+read|est\s+remplac|wird\s+(?:durch|ersetzt))", re.I)
_PAGE_BREAK = re.compile(r"\s*\n\s*[-–—]\s*\d+\s*[-–—]\s*\n\s*")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-¬\u00ad]\r?\n(?=[^\W\d_])")
_UNIT = re.compile(r"(?<=[.!?…:;])\s+|(?<=[。！？；：])|\n+|(?<=[a-zé”“’)])\.(?=[A-Z])")
_OCR = re.compile(r"(?<=[a-z])1|1(?=[a-z])")
_OCR0 = re.compile(r"(?<=[a-z])0|0(?=[a-z])")
_SCANNED = re.compile(r"[01](?:(?<=[A-Za-z][01])[A-Za-z]|(?<![\w.][01])[a-z]{3})")
_APART = re.compile(r"[\W\d_]+")
_CJK = re.compile("[々぀-ヿ㐀-鿿]")
_QUOTED = re.compile("[\"“„«‹「『][^\"“”„«»‹›「」『』\n]{1,120}[\"“”»›」』]")
#: accents, soft hyphens and marks without width
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]")
_SEAM = re.compile("(?<=[々぀-ヿ㐀-鿿])(?=[^々぀-ヿ㐀-鿿 ])|(?<=[^々぀-ヿ㐀-鿿 ])(?=[々぀-ヿ㐀-鿿])")
_GAP = re.compile("(?<=[々぀-ヿ㐀-鿿]) (?=[々぀-ヿ㐀-鿿])")
#: a single line feed, as of a wrapped line
_WRAP = re.compile(r"(?<!\n)[ \t\r]*\n(?![ \t\r]*\n)[ \t]*")
#: each byte of Latin-1 as a letter without its accent, or a space
_PLAIN = bytes(ord(x) if (x := unicodedata.normalize("NFD", chr(c))[0]).isascii() and x.isalpha() else 32 for c in range(256))
_NOT_CJK_LEADS = bytes(set(range(256)) - set(range(0xE3, 0xEA)))
_WIDTHLESS = "\u200b\u200c\u200d\u2060\ufeff"
#: the same word again and again, or the same few characters
_REPEATED_WORD = re.compile(r"(?<!\w)([^\W\d_]{3,30})(?:[\s,.;]+\1){7,}(?!\w)", re.I)
_REPEATED_CJK = re.compile("(([぀-鿿])(?!\\2)[぀-鿿]{1,11}?)\\1{4,}")
#: a line of one character in place of text
_RULES = "Xx_.-=*#…"
_RULE = re.compile(r"^[ \t]*(?:\[\d+\][ \t]*|\d+\.[ \t]*)?([Xx_.\-=*#…])\1{9,}[ \t\r]*$", re.M)


def has_cjk(text: str) -> bool:
    """Whether Chinese or Japanese characters may be in a text, by the bytes that begin them."""
    return not text.isascii() and bool(text.encode("utf-8", "replace").translate(None, _NOT_CJK_LEADS)) and _CJK.search(text) is not None


def fold(text: str, ocr: bool = False) -> str:
    """The words of text without case and accents, one space around each; Chinese and Japanese runs count as words.

    Texts and phrases go the same way. Without Chinese or Japanese, letters of other scripts than Latin are left out.
    ocr: digits 1 and 0 in words are read as l and o.
    """
    t = text.casefold()
    if ocr:
        t = _OCR0.sub("o", _OCR.sub("l", t))
    if not t.isascii():
        if not unicodedata.is_normalized("NFKC", t):
            t = unicodedata.normalize("NFKC", t)
        if has_cjk(t):
            t = _APART.sub(" ", unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", t))))
            t = _GAP.sub("", _SEAM.sub(" ", t))
            return f" {t.strip()} ".replace("rn", "m").replace(" java script", " javascript")
        for mark in _WIDTHLESS:
            if mark in t:
                t = t.replace(mark, "")
    t = t.encode("latin-1", "replace").translate(_PLAIN, b"\xad").decode("ascii")
    return f" {' '.join(t.split())} ".replace("rn", "m").replace(" java script", " javascript")


def repeated(text: str) -> str | None:
    """A word repeated eight times in a row, or a few Chinese or Japanese characters five times."""
    w = text.split()
    if any(map(operator.eq, w, w[1:])) and any(a == b == c for a, b, c in zip(w, w[1:], w[2:])):
        m = _REPEATED_WORD.search(text)
        if m:
            return m.group()[:80]
    if has_cjk(text):
        m = _REPEATED_CJK.search(text)
        if m:
            return m.group()[:80]
    return None


@lru_cache(maxsize=1)
def hints() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for h in HINTS:
        a.add_word(h, 1)
    a.make_automaton()
    return a


CORE, CONTEXT, SMALL, FILLER, BESIDE, STEM = 1, 2, 4, 8, 16, 32
#: letters by which a word may go on after a stem
ENDING = 5


def key_of(phrase: str) -> str:
    """A phrase as the automaton looks for it: whole words, or Chinese and Japanese characters anywhere."""
    k = fold(phrase)
    return (k[1:] if _CJK.match(k[1]) else k)[: -1 if _CJK.match(k[-2]) else None] if k.strip() else ""


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """(of core phrases and filler, of all phrases), with the length and the families of each."""
    families: dict[str, int] = {}
    lists = [(family, lang[name].split("\n")) for lang in phrases.LANGUAGES for name, family in (("core", CORE), ("context", CONTEXT))]
    lists += [(SMALL, lang["small"].split()) for lang in phrases.LANGUAGES] + [(FILLER, phrases.FILLER.split("\n")), (BESIDE, phrases.FILLER_CONTEXT.split("\n"))]
    for family, words in lists:
        for p in words:
            if k := key_of(p.removesuffix("-")):
                k, more = (k[:-1], STEM) if p.endswith("-") else (k, 0)
                families[k] = families.get(k, 0) | family | more
    gate, full = ahocorasick.Automaton(), ahocorasick.Automaton()
    for k, f in families.items():
        full.add_word(k, (len(k), f))
        if f & (CORE | FILLER):
            gate.add_word(k, 1)
    gate.make_automaton(), full.make_automaton()
    return gate, full


def coverage(folded: str) -> tuple[float, float]:
    """(share of the letters of a folded unit that notices cover, that filler covers); 0 without a core phrase or filler.

    Words that say nothing are left out of the letters, unless they are within a phrase.
    """
    notice, filler, small = bytearray(len(folded)), bytearray(len(folded)), bytearray(len(folded))
    seen = 0
    for end, (n, family) in automata()[1].iter(folded):
        if family & STEM:
            rest = folded.find(" ", end) - 1 - end
            if rest > ENDING:
                continue
            end, n = end + rest, n + rest
        at = slice(end + 1 - n, end + 1)
        seen |= family
        if family & (CORE | CONTEXT):
            notice[at] = b"\1" * n
        if family & (FILLER | BESIDE):
            filler[at] = b"\1" * n
        if family & SMALL:
            small[at] = b"\1" * n
    out = []
    for covered, need in ((notice, CORE), (filler, FILLER)):
        share = 0.0
        if seen & need:
            letters = hits = 0
            for c, hit, s in zip(folded, covered, small):
                if c != " " and (hit or not s):
                    letters += 1
                    hits += hit
            share = hits / letters if letters else 0.0
        out.append(share)
    return out[0], out[1]


def spoken_of(unit: str, ocr: bool = False) -> bool:
    """Whether core phrases stand only in quotation marks, in a unit that has words of its own around them."""
    outside = _QUOTED.sub(" ", unit)
    if outside == unit:
        return False
    rest = fold(outside, ocr)
    return next(automata()[0].iter(rest), None) is None and 3 * len(rest) > len(fold(unit, ocr))


def placeholder(text: str) -> str | None:
    """The first unfilled placeholder of text that isn't quoted or spoken of."""
    dense = "".join(text.split()).lower()
    if not dense.isascii():
        for a, b in _SAME:
            dense = dense.replace(a, b)
    if next(hints().iter(dense), None) is None:
        return None
    for m in PLACEHOLDER.finditer(text):
        before, after = text[max(0, m.start() - 40) : m.start()].rstrip(" \u00a0"), text[m.end() : m.end() + 40].lstrip(" \u00a0")
        quoted = before[-1:] != "" and before[-1] in _QUOTES and after[:1] != "" and after[0] in _QUOTES
        if not quoted and not _MENTION.search(before) and not _MENTIONED.match(after):
            return m.group()
    return None


def residue(text: str | None, share: float = SHARE) -> str | None:
    """placeholder, filler, error or script residue of a text, as the text that shows it; None if there is none."""
    if not text or text.isspace():
        return None
    plain = html.unescape(text) if "&" in text else text
    joined = _PAGE_BREAK.sub(" ", plain) if "\n- " in plain or "\n– " in plain else plain
    joined = _HYPHEN.sub("", joined) if "-\n" in joined or "-\r\n" in joined else joined
    found = placeholder(joined)
    if found:
        return found
    found = repeated(plain)
    if found:
        return found
    m = _RULE.search(plain) if any(c * 10 in plain for c in _RULES) else None
    if m:
        return m.group().strip()[:80]
    gate = automata()[0]
    scanned = _SCANNED.search(plain) is not None
    if next(gate.iter(fold(joined)), None) is None and not (scanned and next(gate.iter(fold(joined, True)), None) is not None):
        return None
    lines = [joined] if len(joined) <= WHOLE else []
    for line in joined.split("\n"):
        lines += (line, *_UNIT.split(line))
    if "\n" in joined:  # sentences over wrapped lines
        for paragraph in _WRAP.sub(" ", joined).split("\n"):
            lines += _UNIT.split(paragraph)
    done = set()
    for unit in lines:
        if unit and unit not in done and not unit.isspace():
            done.add(unit)
            for ocr in (False, True)[: 1 + scanned]:
                folded = fold(unit, ocr)
                if next(gate.iter(folded), None) is not None and max(coverage(folded)) >= share and not spoken_of(unit, ocr):
                    return unit.strip()[:200]
    return None


def detect(docs: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """(key, residue BOOLEAN, evidence STRING) of every row; null, empty and blank texts have none.

    share: how much of the letters of a line or sentence the phrases must cover. Texts are read whole; repeated rows stay, extra
    columns are dropped. One narrow stage without a shuffle.
    """
    schema = docs.select(F.col(f"`{key}`")).schema.add("residue", BooleanType()).add("evidence", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [residue(t, share) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f is not None for f in found], pa.bool_()), pa.array(found, pa.string())], names=[key, "residue", "evidence"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def clean(docs: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """docs without the rows that have residue, in one narrow stage."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(text)
        for b in batches:
            yield b.filter(pa.array([residue(t, share) is None for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
