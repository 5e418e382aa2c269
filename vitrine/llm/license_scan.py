"""License scan: Aho-Corasick over words, shunting-yard over identifier tags.

Two automata, built once per worker out of fixed lists, read each whole text:

* words: A-Z lower-cased, runs of digits, letters and non-ASCII characters,
  joined by single spaces. Every place where a phrase's words stand one after
  another is a hit (base phrases of the contract, and the method's notices).
* tags: the raw text is searched for identifier tags
  (``SPDX-License-Identifier:``); what follows up to the line's end or its next
  tag, or else the longest well-formed expression at its start, is parsed by a
  shunting-yard parser for ``and`` / ``or`` / ``with`` / parentheses. Every
  character is parsed once, however many tags a line holds.

Per text: number of words, number of base places, first and last word at which
a base place starts, base labels, all labels (base, notices and the licences
of well-formed tags), a score, and the tags' normalised expressions.

Only known licence identifiers, and references to a text of one's own
(``LicenseRef-``), are labels; other words after a tag are not.

Score: 1.0 for a well-formed tag of known licences and exceptions, 0.9 for a
base phrase, 0.7 for a notice alone, 0.5 for a tag with a reference or an
unknown exception, 0.3 for one with an unknown licence, one that doesn't parse
or one that breaks off after an operator (what stands before it still counts),
0.0 for nothing. The highest counts.

One narrow pass, no shuffle: rows are judged one by one in Arrow batches, in
chunks of bounded bytes. Defined results: null text is empty: no words, no
labels (empty strings), score 0. Overlapping places all count. Repeated rows
repeat. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read

# Fixed values of the contract: base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of well-known licences and the method's labels for them.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-identifier:")
# Identifiers of the SPDX licence list in common use, lower case; a version of a family
# that isn't listed is known too if the family is (``_FAMILY``).
IDENTIFIERS = frozenset("""
    0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware
    blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl
    bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0
    cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-pddc cc0-1.0 cddl-1.0 cddl-1.1
    cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1
    eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg imagemagick intel ipa ipl-1.0 isc
    json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff linux-openib lpl-1.02 lppl-1.3c mit mit-0 mit-cmu mit-modern-variant
    mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogl-uk-3.0
    oldap-2.8 openssl osl-1.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0
    sspl-1.0 sunpro tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zend-2.0 zlib zpl-2.1
""".split())
# Exceptions of that list in common use.
EXCEPTIONS = frozenset("""
    389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0
    clisp-exception-2.0 fltk-exception font-exception-2.0 freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1
    gnu-javamail-exception gpl-3.0-linking-exception gpl-cc-1.0 i2p-gpl-java-exception lgpl-3.0-linking-exception
    libtool-exception linux-syscall-note llvm-exception lzma-exception mif-exception ocaml-lgpl-linking-exception
    openjdk-assembly-exception-1.0 openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1
    swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())
_FAMILY = re.compile(r"(?:agpl|lgpl|gpl|apache|mpl|bsd|epl|cc-by(?:-nc)?(?:-nd|-sa)?)(?:-\d+(?:\.\d+)*(?:-clause)?)?")

# Word characters: everything but ASCII other than 0-9 and a-z, after lower-casing.
_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
              else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_NEXT = re.compile(rf"\s*({_TOKEN.pattern})")
_BREAKS_OFF = re.compile(r"\s*(?:and|or|with)\b", re.IGNORECASE)
_RANK = {"or": 1, "and": 2, "with": 3}


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_WORD).split()


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: postfix tokens (operators lower case), None if it isn't well formed.

    ``with`` binds closer than ``and``, ``and`` closer than ``or``; operators
    are left-associative; ``with`` takes a single exception name on its right.
    """
    out, ops, operand = [], [], True      # operand: one is expected next
    tokens = _TOKEN.findall(expression)
    if "".join(tokens) != re.sub(r"\s+", "", expression):
        return None
    for i, token in enumerate(tokens):
        low = token.lower()
        if low in _RANK:
            if operand or low == "with" and (tokens[i - 1] == ")" or (ops and ops[-1] == "with")):
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif token == "(":
            if not operand or (ops and ops[-1] == "with"):
                return None
            ops.append(token)
        elif token == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand:
        return None
    while ops:
        if ops[-1] == "(":
            return None
        out.append(ops.pop())
    return out


def longest_start(line: str) -> tuple[str, bool]:
    """(longest well-formed expression at the start of a line, whether an operator follows it)."""
    at = good = depth = 0
    operand, with_open, last = True, False, ""
    while found := _NEXT.match(line, at):
        token = found[1]
        low, name = token.lower(), token
        if low in _RANK:
            if operand or low == "with" and (last == ")" or with_open):
                break
            operand, with_open = True, low == "with"
        elif token == "(":
            if not operand or with_open:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth, with_open = depth - 1, False
        else:
            name = token.rstrip(".:-")
            if not operand or not name:
                break
            operand = False
        at, last = found.start(1) + len(name), token
        if not operand and not depth:
            good = at
        if name != token:      # the end of a sentence or comment
            break
    return line[:good], bool(_BREAKS_OFF.match(line, good))


def kind_of(identifier: str) -> str:
    """``known``, ``reference`` (to a text of one's own) or ``unknown``."""
    low = identifier.lower()
    if low.split(":")[-1].startswith("licenseref-"):
        return "reference"
    plain = re.sub(r"(?:-only|-or-later|\+)$", "", low)
    return "known" if plain in IDENTIFIERS or _FAMILY.fullmatch(plain) else "unknown"


def label_of(identifier: str) -> str:
    """A licence identifier's label: its family if known, else itself in lower case."""
    low = identifier.lower()
    for family in ("agpl", "lgpl", "gpl", "apache", "mpl", "bsd", "epl", "mit", "isc"):
        if low == family or low.startswith(family + "-"):
            return family
    return low


def normalised(postfix: list[str]) -> tuple[set[str], str]:
    """(licences, normalised text), without listing alternatives; an exception isn't a licence."""
    stack: list[tuple[set[str], deque[str], int]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append(({token}, deque([token]), 9))
            continue
        (b, right, br), (a, left, ar) = stack.pop(), stack.pop()
        rank = _RANK[token]
        for side, r in ((left, ar), (right, br)):
            if r < rank:
                side.appendleft("(")
                side.append(")")
        # The smaller part is added to the larger one, so long chains stay cheap on either side.
        if len(left) >= len(right):
            left.append(f" {token.upper()} ")
            left.extend(right)
        else:
            right.appendleft(f" {token.upper()} ")
            right.extendleft(reversed(left))
            left = right
        if token != "with":
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            a |= b
        stack.append((a, left, rank))
    return stack[0][0], "".join(stack[0][1])


def exceptions_of(postfix: list[str]) -> set[str]:
    """The names on the right of ``with``: each stands just before it."""
    return {postfix[i - 1] for i, token in enumerate(postfix) if token == "with"}


def evaluate(postfix: list[str]) -> tuple[list[list[str]], str]:
    """(alternatives, normalised text): each alternative lists the licences that hold together; all
    are listed, whose number may grow with the power of the length (the scan lists none)."""
    stack: list[list[frozenset]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append([frozenset([token])])
            continue
        b, a = stack.pop(), stack.pop()
        if token == "or":
            a = a + b
        elif token == "and":
            a = [x | y for x in a for y in b]
        stack.append(a)      # an exception changes its licence, it isn't one
    return [sorted(s) for s in dict.fromkeys(stack[0])], normalised(postfix)[1]


def _automaton(phrases) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, value in phrases:
        found.add_word(phrase, value)
    found.make_automaton()
    return found


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES, tags=TAGS):
        self.words = _automaton((f" {p} ", (p, base.get(p), notices.get(p))) for p in {**base, **notices})
        self.tags = _automaton((t, t) for t in tags)

    def tag_lines(self, body: bytes) -> list[str]:
        """What follows each tag, up to the line's end or the next tag."""
        low = body.lower()      # of bytes: same length
        if b"license-identifier:" not in low:
            return []
        text = body.decode("utf-8", "replace")
        begins: dict[int, int] = {}      # a tag's end: the first of its beginnings
        for end, tag in self.tags.iter(low.decode("utf-8", "replace")):
            begins[end + 1] = min(begins.get(end + 1, end + 1), end + 1 - len(tag))
        ends = sorted(begins)
        stops = [begins[e] for e in ends[1:]] + [len(text)]
        return [text[a:b].split("\n", 1)[0].strip().rstrip("*/ ->.") for a, b in zip(ends, stops)]

    def scan(self, body: bytes) -> tuple:
        words = words_of(body)
        joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace") if words else ""
        n_base, first, last, base_labels, labels, score = 0, None, None, set(), set(), 0.0
        at_char = at_word = 0
        hits = sorted((end - len(p) - 1, p, base, notice) for end, (p, base, notice) in self.words.iter(joined)) if joined else []
        for start, _, base, notice in hits:
            at_word += joined.count(" ", at_char, start)
            at_char = start
            if base:
                n_base += 1
                first = at_word if first is None else first
                last = at_word
                base_labels.add(base)
                score = max(score, 0.9)
            if notice:
                labels.add(notice)
                score = max(score, 0.7)
        expressions = []
        for line in self.tag_lines(body):
            postfix, broken = to_postfix(line), False
            if postfix is None:
                start, broken = longest_start(line)
                postfix = to_postfix(start)
            if postfix is None:
                score = max(score, 0.3)
                continue
            licences, written = normalised(postfix)
            expressions.append(written)
            kinds = {name: kind_of(name) for name in licences}
            labels.update(label_of(name) for name, kind in kinds.items() if kind != "unknown")
            odd = any(e.lower() not in EXCEPTIONS for e in exceptions_of(postfix))
            score = max(score, 0.3 if broken or "unknown" in kinds.values()
                        else 0.5 if odd or "reference" in kinds.values() else 1.0)
        return (len(words), n_base, first, last, ",".join(sorted(base_labels)),
                ",".join(sorted(base_labels | labels)), score, expressions)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, expressions array<string>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                    ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])


def _scan(base, notices, tags):
    def run(batches):
        scanner = Scanner(base, notices, tags)
        for ids, bodies in bounded_chunks(batches):
            rows = [(i, *scanner.scan(b)) for i, b in zip(ids, bodies)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
    return run


def license_scan(docs: DataFrame, base: dict = BASE, notices: dict = NOTICES, tags: tuple = TAGS) -> DataFrame:
    prepare(docs.sparkSession)
    return id_and_bytes(docs).mapInArrow(_scan(base, notices, tags), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and labels of all whole documents."""
    return license_scan(read(spark, sf_dir, "documents"))
