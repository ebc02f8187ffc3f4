"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases,
and a shunting-yard parser evaluates and/or/with licence expressions after a tag.

Identifiers come from families and their versions by rule; each gives the label of its
family, a whole identifier with its version, and the ways in which notices write it
("GPLv3", "GPL version 3", "BSD 3-Clause License"). Names that products share ("Python
2.0") count only where the text names a licence next to them or writes the identifier
itself. An evaluated expression tells the licences that bind whatever is chosen from those
that are only offered.

Words are runs of letters a-z (A-Z folded), digits and anything beyond ASCII. A null
text is empty; a very long one is scanned whole, in linear time. Repeated places are all
counted; phrases that overlap or tie for a place all count. Other columns are not looked
at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases that the method adds, and their labels.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "eclipse distribution license": "bsd",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "sil open font license": "ofl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "open data commons": "odc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}
#: Families of licence identifiers, (label, versions after a dash; "" stands for the family alone).
FAMILIES = {
    "0BSD": ("bsd", ""), "AFL": ("afl", "1.1 1.2 2.0 2.1 3.0"), "AGPL": ("agpl", "1.0 3.0"), "Apache": ("apache", "1.0 1.1 2.0"),
    "APSL": ("apsl", "1.0 1.1 1.2 2.0"), "Artistic": ("artistic", "1.0 1.0-cl8 1.0-Perl 2.0"), "BlueOak": ("blueoak", "1.0.0"),
    "BSD": ("bsd", "1-Clause 2-Clause 2-Clause-Patent 3-Clause 3-Clause-Clear 3-Clause-LBNL 4-Clause 4-Clause-UC Source-Code"),
    "BSL": ("bsl", "1.0"), "BUSL": ("busl", "1.1"), "CAL": ("cal", "1.0"), "CC0": ("cc0", "1.0"), "CC-BY": ("cc-by", "1.0 2.0 2.5 3.0 4.0"),
    "CC-BY-NC": ("cc-by-nc", "1.0 2.0 2.5 3.0 4.0"), "CC-BY-NC-ND": ("cc-by-nc-nd", "1.0 2.0 2.5 3.0 4.0"),
    "CC-BY-NC-SA": ("cc-by-nc-sa", "1.0 2.0 2.5 3.0 4.0"), "CC-BY-ND": ("cc-by-nd", "1.0 2.0 2.5 3.0 4.0"),
    "CC-BY-SA": ("cc-by-sa", "1.0 2.0 2.5 3.0 4.0"), "CDDL": ("cddl", "1.0 1.1"), "CECILL": ("cecill", "1.0 1.1 2.0 2.1 B C"),
    "CPAL": ("cpal", "1.0"), "CPL": ("cpl", "1.0"), "ECL": ("ecl", "1.0 2.0"), "EFL": ("efl", "1.0 2.0"), "EPL": ("epl", "1.0 2.0"),
    "EUPL": ("eupl", "1.0 1.1 1.2"), "GFDL": ("gfdl", "1.1 1.2 1.3"), "GPL": ("gpl", "1.0 2.0 3.0"), "HPND": ("hpnd", ""), "ICU": ("icu", ""),
    "IPL": ("ipl", "1.0"), "ISC": ("isc", ""), "LGPL": ("lgpl", "2.0 2.1 3.0"), "LPL": ("lpl", "1.0 1.02"), "LPPL": ("lppl", "1.0 1.1 1.2 1.3a 1.3c"),
    "MIT": ("mit", " 0 CMU Modern-Variant"), "MPL": ("mpl", "1.0 1.1 2.0 2.0-no-copyleft-exception"), "MS-PL": ("ms-pl", ""), "MS-RL": ("ms-rl", ""),
    "MulanPSL": ("mulanpsl", "1.0 2.0"), "NCSA": ("ncsa", ""), "ODbL": ("odc", "1.0"), "ODC-By": ("odc", "1.0"), "OFL": ("ofl", "1.0 1.1"),
    "OpenSSL": ("openssl", ""), "OSL": ("osl", "1.0 1.1 2.0 2.1 3.0"), "PDDL": ("odc", "1.0"), "PHP": ("php", "3.0 3.01"), "PostgreSQL": ("postgresql", ""),
    "PSF": ("psf", "2.0"), "Python": ("psf", "2.0"), "QPL": ("qpl", "1.0"), "Ruby": ("ruby", ""), "SSPL": ("sspl", "1.0"), "Unicode": ("unicode", "3.0 DFS-2015 DFS-2016"),
    "Unlicense": ("unlicense", ""), "UPL": ("upl", "1.0"), "Vim": ("vim", ""), "W3C": ("w3c", ""), "WTFPL": ("wtfpl", ""), "X11": ("x11", ""),
    "Zend": ("zend", "2.0"), "Zlib": ("zlib", ""), "ZPL": ("zpl", "1.1 2.0 2.1"),
}
#: Families whose names also stand for products or other things; their bare name and version tell no licence.
PRODUCTS = (
    "AFL", "Apache", "Artistic", "BlueOak", "CAL", "CPL", "ECL", "EFL", "HPND", "ICU", "IPL", "LPL", "OpenSSL", "PHP", "PostgreSQL", "PSF",
    "Python", "Ruby", "Unicode", "UPL", "Vim", "W3C", "X11", "Zend", "Zlib",
)
#: Families whose identifiers may end in -only, -or-later or a plus sign.
GNU = ("AGPL", "GFDL", "GPL", "LGPL")


def identifiers() -> dict[str, tuple[str, str]]:
    """(identifier, label) of each licence identifier, by its lower-case form."""
    out = {}
    for family, (label, versions) in FAMILIES.items():
        for version in versions.split(" "):
            name = f"{family}-{version}" if version else family
            for end in ("", "-only", "-or-later") if family in GNU else ("",):
                out[(name + end).lower()] = (name + end, label)
    return out


KNOWN = identifiers()


def identifier_phrases() -> dict[str, tuple[str, str, bool]]:
    """(label, identifier, whether a licence must be named close by) by the ways in which notices write a licence and its version."""
    out: dict[str, tuple[str, str, bool]] = {}
    for family, (label, versions) in FAMILIES.items():
        name = " ".join(re.findall("[a-z0-9]+", family.lower()))
        for version in versions.split(" "):
            identifier = f"{family}-{version}" if version else family
            words = " ".join(re.findall("[a-z0-9]+", version.lower()))
            forms = [f"{name} {words} license", f"{name} {words} licence"] if version else [f"{name} license", f"{name} licence"]
            bare = []
            if re.match(r"\d+\.\d", version):
                short = words.removesuffix(" 0")
                forms += [f"{name} {w} {v}" for w in ("license version", "license v", "license") for v in (words, short)]
                bare += [f"{name} {w} {v}" for w in ("version", "v") for v in (words, short)]
                bare += [f"{name} {words}", f"{name} v{words}", f"{name} v{short}", f"{name}v{words}", f"{name}v{short}", f"{name}{words}"]
                bare += [f"{name}{short}"] if family in GNU else []
            elif " " in words:
                bare.append(f"{name} {words}")
            for form in forms + bare:
                if form not in BASE_PHRASES:
                    out.setdefault(form, (label, identifier, family in PRODUCTS and form in bare))
    return out


#: Characters of the normalised text before and after a bare name in which a licence must be named.
BEFORE, AFTER = 40, 20
_NAMED = re.compile(r" (?:re|sub|dual)?licen[cs](?:e|es|ed|ing) ")


def licence_near(line: str, start: int, end: int, raw: bytes, identifier: str) -> bool:
    """Whether the text names a licence next to ``line[start:end]``, or writes the identifier itself."""
    return bool(_NAMED.search(f" {line[max(0, start - BEFORE) : start]} ") or _NAMED.search(f" {line[end : end + AFTER]} ")) or identifier.lower().encode() in raw.lower()


#: Words that name an identifier tag in a text.
TAG = "spdx license identifier"

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TAG_AT = re.compile(r"spdx-license-identifier:", re.IGNORECASE | re.ASCII)
#: Where the expression after a tag ends at the latest.
_TAG_END = re.compile(r"[\r\n]|spdx-license-identifier:", re.IGNORECASE | re.ASCII)
_PIECE = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def known(identifier: str) -> tuple[str, str] | None:
    """(whole identifier, label), or None if it is not known; an unknown version of a known family counts as the family."""
    low = identifier.lower()
    if low in KNOWN:
        return KNOWN[low]
    if low.endswith("+") and low[:-1] in KNOWN:
        name, label = KNOWN[low[:-1]]
        return f"{name}-or-later" if f"{low[:-1]}-or-later" in KNOWN else f"{name}+", label
    family = max((f for f in FAMILIES if low.rstrip("+") == f.lower() or low.startswith(f.lower() + "-")), key=len, default=None)
    return (identifier, FAMILIES[family][0]) if family else None


def parse_expression(text: str) -> list[str]:
    """The longest licence expression at the start of ``text``, in postfix order.

    ``with`` binds closer than ``and``, ``and`` closer than ``or``. Reading stops where
    an operand or operator is missing, and what was read so far counts.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for m in _PIECE.finditer(text):
        piece, low = m[0], m[0].lower()
        if piece == "(":
            if not operand_next:
                break
            waiting.append(piece)
        elif piece == ")":
            if operand_next or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif low in _BINDS:
            if operand_next:
                break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(piece)
            operand_next = False
    while operand_next and waiting:  # what lacks an operand goes, with brackets that hold nothing
        operand_next = waiting.pop() == "("
    out.extend(x for x in reversed(waiting) if x != "(")
    return out


def evaluate_expression(postfix: list[str]) -> tuple[set[str], set[str], float]:
    """(identifiers that bind, all identifiers, certainty) of a postfix expression.

    ``and`` binds both sides and is as sure as the less sure one; ``or`` offers either
    and binds only what both share; ``with`` keeps the licence and drops the exception's name.
    """
    stack: list[tuple[set[str], set[str], float]] = []
    for piece in postfix:
        if piece in _BINDS and len(stack) >= 2:
            (b_must, b_any, b_sure), (a_must, a_any, a_sure) = stack.pop(), stack.pop()
            if piece == "with":
                stack.append((a_must, a_any, a_sure))
            elif piece == "and":
                stack.append((a_must | b_must, a_any | b_any, min(a_sure, b_sure)))
            else:
                stack.append((a_must & b_must, a_any | b_any, max(a_sure, b_sure)))
        elif piece not in _BINDS:
            found = known(piece)
            stack.append(({found[0]}, {found[0]}, 1.0) if found else (set(), set(), 0.0))
    return stack[-1] if stack else (set(), set(), 0.0)


def _automaton() -> ahocorasick.Automaton:
    """Phrases to (words, characters, label, whole identifier, whether of the base, whether a licence must be named close by)."""
    a = ahocorasick.Automaton()
    for phrase, (label, identifier, bare) in identifier_phrases().items():
        a.add_word(f" {phrase} ", (phrase.count(" "), len(phrase), label, identifier, False, bare))
    for phrase, label in NOTICE_PHRASES.items():
        a.add_word(f" {phrase} ", (phrase.count(" "), len(phrase), label, None, False, False))
    for phrase, label in BASE_PHRASES.items():
        a.add_word(f" {phrase} ", (phrase.count(" "), len(phrase), label, None, True, False))
    a.add_word(f" {TAG} ", (TAG.count(" "), len(TAG), None, None, False, False))
    a.make_automaton()
    return a


def scan_text(raw: bytes, automaton: ahocorasick.Automaton) -> dict:
    """Words, places and labels of one text in UTF-8."""
    words = raw.translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    found: dict[int, tuple[int, str]] = {}  # by start, of the longest phrase there
    binding: set[str] = set()
    offered: set[str] = set()
    tagged, seen, at, named = False, 0, 0, False
    for end, (gaps, size, label, identifier, is_base, alone) in automaton.iter(line):
        seen += line.count(" ", at, end)  # spaces before the phrase's last one: its last word's number, from 1
        at = end
        if label is None:
            tagged = True
            continue
        if alone and not licence_near(line, end - size, end, raw, identifier):
            continue
        labels.add(label)
        named |= bool(identifier) and not alone
        if identifier:
            found[seen - 1 - gaps] = max(found.get(seen - 1 - gaps, (0, "")), (gaps, identifier))
        if is_base:
            base.add(label)
            starts.append(seen - 1 - gaps)
    score = 0.9 if base or named else 0.8 if found else 0.7 if labels else 0.0
    expressions: list[str] = []
    if tagged:
        text = raw.decode("utf-8", "replace")
        for m in _TAG_AT.finditer(text):
            stop = _TAG_END.search(text, m.end())
            postfix = parse_expression(text[m.end() : stop.start() if stop else len(text)])
            must, any_, sure = evaluate_expression(postfix)
            binding |= must
            offered |= any_ - must
            labels |= {known(x)[1] for x in any_}
            score = max(score, sure)
            expressions.append(" ".join(postfix))
    listed = lambda x: ",".join(sorted(x))
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": listed(base), "labels": listed(labels), "score": score, "binding": listed(binding), "offered": listed(offered - binding),
        "noticed": listed({x for _, x in found.values()}), "expressions": expressions,
    }


_OUT = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("binding", pa.string()), ("offered", pa.string()), ("noticed", pa.string()), ("expressions", pa.list_(pa.string())),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = pa.RecordBatch.from_pylist([scan_text(x.as_py() or b"", automaton) for x in texts], schema=_OUT)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], names=["doc_id", *_OUT.names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: places and labels of base phrases, all labels and a score.

    ``expressions`` are those after tags, in postfix order; ``binding`` the whole identifiers that hold
    whatever is chosen, ``offered`` those that only a choice brings; ``noticed`` come from phrases.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    out = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, binding string, offered string, noticed string, expressions array<string>"
    )
    return picked.mapInArrow(_scan, out)


def op10_license_scan(docs: DataFrame) -> DataFrame:
    """The digest of ``scan_licenses`` over documents."""
    return scan_licenses(docs)
