"""License scans by template-markup matching.

A license template is wording with markup: ``[[ ... ]]`` is optional, ``{a b|c}`` is one of several wordings and
``<name:lo-hi>`` is a replaceable region of lo to hi words.  A template is compiled into an automaton over words;
a text has the license where the automaton accepts a run of its words, so mandatory wording must match exactly.
Words are compared after lower-casing A-Z, without punctuation.  A template starts with mandatory wording: its
first literal words are searched for as bytes, and the automaton runs only there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .frames import by_batch, keys_and_text, table
from .words import ALNUM

_TO_SPACE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if ALNUM[b] else 32 for b in range(256))

# The phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Full texts, all of whose wording is mandatory but holders and numbering.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all "
    "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and {noninfringement|non infringement} in no event shall <holder:1-12> be liable for any claim damages or other liability whether "
    "in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software "
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[ [[3]] all advertising materials mentioning features or use "
    "of this software must display the following {acknowledgement|acknowledgment} this product includes software developed by <holder:1-20> ]] [[ [[{3|4}]] neither the name of "
    "<holder:1-12> nor the names of {its|the|any} contributors may be used to endorse or promote products derived from this software without specific prior written permission]] this "
    "software is provided by <holder:1-12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed in no event shall <holder:1-12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
    "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage "
)
_ISC = (
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies the software is provided as is and <holder:1-12> disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall <holder:1-12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
    "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software "
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
    "or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate "
    "any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
    "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is "
    "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {noninfringement|non "
    "infringement} in no event shall <holder:1-12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software "
)
_APACHE = (
    "apache license version 2 0 january 2004 [[{http|https} www apache org licenses]] terms and conditions for use reproduction and distribution 1 definitions license shall mean the "
    "terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the "
    "copyright owner that is granting the license legal entity shall mean the union of the acting entity and all other entities that control are controlled by or are under common "
    "control with that entity for the purposes of this definition control means i the power direct or indirect to cause the direction or management of such entity whether by contract or "
    "otherwise or ii ownership of fifty percent 50 or more of the outstanding shares or iii beneficial ownership of such entity you or your shall mean an individual or legal entity "
    "exercising permissions granted by this license source form shall mean the preferred form for making modifications including but not limited to software source code documentation "
    "source and configuration files object form shall mean any form resulting from mechanical transformation or translation of a source form including but not limited to compiled object "
    "code generated documentation and conversions to other media types work shall mean the work of authorship whether in source or object form made available under the license as "
    "indicated by a copyright notice that is included in or attached to the work an example is provided in the appendix below derivative works shall mean any work whether in source or "
    "object form that is based on or derived from the work and for which the editorial revisions annotations elaborations or other modifications represent as a whole an original work of "
    "authorship for the purposes of this license derivative works shall not include works that remain separable from or merely link or bind by name to the interfaces of the work and "
    "derivative works thereof contribution shall mean any work of authorship including the original version of the work and any modifications or additions to that work or derivative "
    "works thereof that is intentionally submitted to licensor for inclusion in the work by the copyright owner or by an individual or legal entity authorized to submit on behalf of the "
    "copyright owner for the purposes of this definition submitted means any form of electronic verbal or written communication sent to the licensor or its representatives including but "
    "not limited to communication on electronic mailing lists source code control systems and issue tracking systems that are managed by or on behalf of the licensor for the purpose of "
    "discussing and improving the work but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright owner as not a contribution "
    "contributor shall mean licensor and any individual or legal entity on behalf of whom a contribution has been received by licensor and subsequently incorporated within the work 2 "
    "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free "
    "irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or "
    "object form 3 grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge "
    "royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work where such license applies "
    "only to those patent claims licensable by such contributor that are necessarily infringed by their contribution s alone or by combination of their contribution s with the work to "
    "which such contribution s was submitted if you institute patent litigation against any entity including a cross claim or counterclaim in a lawsuit alleging that the work or a "
    "contribution incorporated within the work constitutes direct or contributory patent infringement then any patent licenses granted to you under this license for that work shall "
    "terminate as of the date such litigation is filed 4 redistribution you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without "
    "modifications and in source or object form provided that you meet the following conditions a you must give any other recipients of the work or derivative works a copy of this "
    "license and b you must cause any modified files to carry prominent notices stating that you changed the files and c you must retain in the source form of any derivative works that "
    "you distribute all copyright patent trademark and attribution notices from the source form of the work excluding those notices that do not pertain to any part of the derivative "
    "works and d if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy of the attribution "
    "notices contained within such notice file excluding those notices that do not pertain to any part of the derivative works in at least one of the following places within a notice "
    "text file distributed as part of the derivative works within the source form or documentation if provided along with the derivative works or within a display generated by the "
    "derivative works if and wherever such third party notices normally appear the contents of the notice file are for informational purposes only and do not modify the license you may "
    "add your own attribution notices within derivative works that you distribute alongside or as an addendum to the notice text from the work provided that such additional attribution "
    "notices cannot be construed as modifying the license you may add your own copyright statement to your modifications and may provide additional or different license terms and "
    "conditions for use reproduction or distribution of your modifications or for any such derivative works as a whole provided your use reproduction and distribution of the work "
    "otherwise complies with the conditions stated in this license 5 submission of contributions unless you explicitly state otherwise any contribution intentionally submitted for "
    "inclusion in the work by you to the licensor shall be under the terms and conditions of this license without any additional terms or conditions notwithstanding the above nothing "
    "herein shall supersede or modify the terms of any separate license agreement you may have executed with licensor regarding such contributions 6 trademarks this license does not "
    "grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of "
    "the work and reproducing the content of the notice file 7 disclaimer of warranty unless required by applicable law or agreed to in writing licensor provides the work and each "
    "contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or "
    "conditions of title non infringement merchantability or fitness for a particular purpose you are solely responsible for determining the appropriateness of using or redistributing "
    "the work and assume any risks associated with your exercise of permissions under this license 8 limitation of liability in no event and under no legal theory whether in tort "
    "including negligence contract or otherwise unless required by applicable law such as deliberate and grossly negligent acts or agreed to in writing shall any contributor be liable "
    "to you for damages including any direct indirect special incidental or consequential damages of any character arising as a result of this license or out of the use or inability to "
    "use the work including but not limited to damages for loss of goodwill work stoppage computer failure or malfunction or any and all other commercial damages or losses even if such "
    "contributor has been advised of the possibility of such damages 9 accepting warranty or additional liability while redistributing the work or derivative works thereof you may "
    "choose to offer and charge a fee for acceptance of support warranty indemnity or other liability obligations and or rights consistent with this license however in accepting such "
    "obligations you may act only on your own behalf and on your sole responsibility not on behalf of any other contributor and only if you agree to indemnify defend and hold each "
    "contributor harmless for any liability incurred by or claims asserted against such contributor by reason of your accepting any such warranty or additional liability [[end of terms "
    "and conditions]] "
)

# Public wording of licenses and of common notices, as templates.
TEMPLATES = [
    ("mit", "{licensed|released|distributed|available} under [[the terms of]] the {mit|expat} license"),
    ("mit", _MIT),
    ("apache", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("apache", _APACHE),
    ("gpl", "licensed under the [[terms of the]] [[gnu]] general public license [[version {2|3}]] [[or later]]"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "{licensed|distributed|released} under the [[terms of the]] [[gnu]] lesser general public license [[version <number:1-2>]]"),
    ("agpl", "{licensed|distributed|released} under the [[terms of the]] [[gnu]] affero general public license [[version 3]]"),
    ("bsd", _BSD),
    ("bsd", "{licensed|released|distributed} under [[the terms of]] the [[{2|3} clause]] bsd [[{2|3} clause]] license"),
    ("isc", _ISC),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", _UNLICENSE),
    ("cc0", "{licensed|released|dedicated} under [[the]] {cc0|creative commons zero} [[1 0]]"),
    ("cc-by", "{licensed|released|available} under [[a]] [[the]] {cc by|creative commons attribution} {1 0|2 0|2 5|3 0|4 0|international} "),
    ("cc-by-sa", "{licensed|released|available} under [[a]] [[the]] {cc by sa|creative commons attribution share alike|creative commons attribution sharealike}"),
    ("cc-by-nc", "{licensed|released|available} under [[a]] [[the]] {cc by nc|creative commons attribution non commercial|creative commons attribution noncommercial} {1 0|2 0|2 5|3 0|4 0|international|license}"),
    ("cc-by-nc-sa", "{licensed|released|available} under [[a]] [[the]] {cc by nc sa|creative commons attribution noncommercial sharealike}"),
    ("cc-by-nd", "{licensed|released|available} under [[a]] [[the]] {cc by nd|creative commons attribution noderivatives|creative commons attribution no derivatives}"),
    ("proprietary", "copyright <owner:1-12> all rights reserved"),
]

_MARK = re.compile(r"\[\[|\]\]|\{[^{}]*\}|<[^<>]*>|[^\s\[\]{}<>]+")


@dataclass
class Automaton:
    """Word moves and empty moves of each state; state 0 starts and the last accepts.  A move on ``None`` takes any word."""

    label: str
    anchors: list[bytes]
    moves: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    empty: list[set[int]] = field(default_factory=lambda: [set()])

    def state(self) -> int:
        self.moves.append([])
        self.empty.append(set())
        return len(self.moves) - 1

    def wording(self, at: int, words: list[bytes | None]) -> int:
        for w in words:
            to = self.state()
            self.moves[at].append((w, to))
            at = to
        return at

    def close(self, states: set[int]) -> set[int]:
        stack, out = list(states), set(states)
        while stack:
            for to in self.empty[stack.pop()] - out:
                out.add(to)
                stack.append(to)
        return out

    def accepts(self, words: list[bytes]) -> bool:
        """Whether some run of words from the first on is accepted."""
        last = len(self.moves) - 1
        now = self.close({0})
        for w in words:
            now = self.close({to for s in now for want, to in self.moves[s] if want is None or want == w})
            if last in now:
                return True
            if not now:
                return False
        return last in now

    @property
    def longest(self) -> int:
        """Words that an accepted run has at most."""
        return sum(1 for s in self.moves if s)


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template.  Wording must come first: it anchors the search."""
    parts = _MARK.findall(template)
    literal: list[str] = []
    firsts = [""]
    for part in parts:
        if part.startswith("{") and not literal and firsts == [""]:
            firsts = part[1:-1].split("|")
        elif part[0] in "[{<":
            break
        else:
            literal.append(part)
    anchors = [f" {' '.join([first, *literal]).strip()} ".encode() for first in firsts]
    if anchors == [b"  "]:
        raise ValueError("a template starts with mandatory wording")
    out = Automaton(label, anchors)
    at, opened = 0, []
    for part in parts:
        if part == "[[":
            opened.append(at)
        elif part == "]]":
            start, end = opened.pop(), out.state()
            out.empty[at].add(end)
            out.empty[start].add(end)
            at = end
        elif part[0] == "{":
            ends = [out.wording(at, x.encode().split()) for x in part[1:-1].split("|")]
            at = out.state()
            for e in ends:
                out.empty[e].add(at)
        elif part[0] == "<":
            lo, hi = map(int, part[1:-1].split(":")[1].split("-"))
            at = out.wording(at, [None] * lo)
            stops = [at]
            for _ in range(hi - lo):
                at = out.wording(at, [None])
                stops.append(at)
            at = out.state()
            for e in stops:
                out.empty[e].add(at)
        else:
            at = out.wording(at, [part.encode()])
    end = out.state()
    out.empty[at].add(end)
    return out


def _places(norm: bytes, phrase: bytes) -> list[int]:
    """Byte offsets of a phrase with its spaces; places may share a space or overlap."""
    found, at = [], norm.find(phrase)
    while at >= 0:
        found.append(at)
        at = norm.find(phrase, at + 1)
    return found


def scan(text: bytes, base: dict[str, str], automata: list[Automaton]) -> dict:
    """The digest of one text."""
    words = text.translate(_TO_SPACE).split()
    norm = b" " + b" ".join(words) + b" " if words else b""
    labels, spots = set(), []
    for phrase, label in base.items():
        if at := _places(norm, b" " + phrase.encode() + b" "):
            labels.add(label)
            spots += at
    own = set()
    for auto in automata:
        if auto.label not in own:
            for anchor in auto.anchors:
                for at in _places(norm, anchor):
                    if auto.accepts(_from(norm, at, auto.longest)):
                        own.add(auto.label)
                        break
    first = norm.count(b" ", 0, min(spots)) if spots else None
    last = norm.count(b" ", 0, max(spots)) if spots else None
    return {
        "n_words": len(words), "n_base": len(spots), "first_word": first, "last_word": last, "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | own)), "score": 1.0 if own else 0.5 if labels else 0.0,
    }


def _from(norm: bytes, at: int, n: int) -> list[bytes]:
    """The n words from a byte offset on."""
    size = 32 * n
    while True:
        piece = norm[at : at + size]
        words = piece.split()
        if at + size >= len(norm):
            return words[:n]
        if len(words) > n:
            return words[:n]
        size *= 2


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base counts the places where a phrase's words stand one after another, overlaps included; labels adds those
    of the accepting automata.  The score is 1 where an automaton accepts, 0.5 where only a base phrase stands, else
    0.  A text of any length is scanned whole; of several templates of one label the first that accepts is enough.  Null and empty texts have no words, empty labels and score 0; rows with the same id stay apart; a null id is
    kept; an empty table gives no rows; other columns are not read.
    """
    base = BASE if base is None else base
    automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [scan(t or b"", base, automata) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), **{n: [f[n] for f in found] for n in names}}

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(keys_and_text(docs, key, text), work, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
