"""Licence scans: parts of documents against licence templates by the Dice coefficient.

Parts are the whole text, its paragraphs (between blank lines), runs of paragraphs and its
lines. Of runs that overlap the best counts. A part and a
template are sets of word bigrams of the normalised text; the coefficient is twice the
common ones over the sum of both sizes. It can reach a limit t only if the sizes differ by
no more than a factor of ``(2 - t) / t``, so a part is compared with the templates of that
size alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.common import in_workers, sliced
from caselog.llm.decontaminate import words
from caselog.llm.shingles import run_hashes, word_hashes

LIMIT = 0.85

# Names and texts of licences and of the notices by which files name them.
_SHORT = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def _texts() -> Iterator[tuple[str, str]]:
    """Full texts. The Affero one is that of GPL-3.0 with its name and its section 13."""
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text()
        yield name, text
        if name == "GPL-3.0":
            before, rest = text.split("  13. Use with the GNU Affero General Public License.")
            before = before.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
            after = rest[rest.index("  14. "):].replace("GNU General Public", "GNU Affero General Public")
            yield "AGPL-3.0", before + _SECTION_13 + after


_SECTION_13 = "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. "


def _siblings() -> Iterator[tuple[str, str]]:
    """Licences and notices that differ from others in a few words, for the best to win."""
    plain = dict(reversed(_SHORT))  # the first text of each name
    bsd = plain["BSD-2-Clause"]
    conditions, disclaimer = bsd[:bsd.index("THIS SOFTWARE")], bsd[bsd.index("THIS SOFTWARE"):]
    promote = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    yield "BSD-3-Clause", f"{conditions}3. {promote}{disclaimer}"
    yield "BSD-4-Clause", f"{conditions}3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {promote}{disclaimer}"
    yield "BSD-2-Clause", "Licensed under the BSD 2-Clause License."
    yield "MIT-0", plain["MIT"].replace(plain["MIT"][plain["MIT"].index(", subject to"):plain["MIT"].index("THE SOFTWARE IS")], ". ")
    yield "0BSD", plain["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
    for name, family, version in (
            ("GPL-1.0", "", "1"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("AGPL-3.0", "Affero ", "3"),
            ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3")):
        full = f"GNU {family}General Public License"
        thing = "library" if name[0] == "L" else "program"
        grant = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
        doubt = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details."
        copy = f"You should have received a copy of the {full} along with this {thing}."
        yield name, grant
        yield name, grant.replace("either ", "").replace(", or (at your option) any later version", "")
        yield name, f"{grant} {doubt}"
        yield name, f"{grant} {doubt} {copy} If not, see https://www.gnu.org/licenses/."
        yield name, f"{grant} {doubt} {copy[:-1]}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
        yield name, f"This work is licensed under the {full}, version {version}."
        yield name, f"Licensed under the {full}, version {version}."
        yield name, f"Licensed under the {full} v{version}."
    for code, words_of in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC", "-NonCommercial"),
                           ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
        long = f"a Creative Commons Attribution{words_of} 4.0 International License."
        yield f"CC-{code}-4.0", f"This work is licensed under {long}"
        yield f"CC-{code}-4.0", f"Licensed under {long}"
        yield f"CC-{code}-4.0", f"Licensed under CC {code} 4.0."


TEMPLATES = (_SHORT[0], *_texts(), *_siblings(), *_SHORT[1:])


class Templates(NamedTuple):
    """Templates in the order of their sizes."""

    names: list[str]
    sizes: np.ndarray
    bigrams: list[np.ndarray]
    every: np.ndarray
    """The bigrams of all templates."""
    holds: np.ndarray
    """Whether a template (row) has a bigram of ``every`` (column)."""


def bigrams(text: str | None) -> np.ndarray:
    """Hashes of the distinct word bigrams: lower case, punctuation aside. One word is one."""
    found = words(text)
    return np.unique(run_hashes(word_hashes(found), min(2, len(found)))) if found else np.zeros(0, np.uint64)


def templates(texts: tuple[tuple[str, str], ...] = TEMPLATES) -> Templates:
    known = sorted(((bigrams(text), name) for name, text in texts), key=lambda x: (len(x[0]), x[1]))
    every = np.unique(np.concatenate([b for b, _ in known])) if known else np.zeros(0, np.uint64)
    holds = np.array([np.isin(every, b, assume_unique=True) for b, _ in known]).reshape(len(known), len(every))
    return Templates([n for _, n in known], np.array([len(b) for b, _ in known]), [b for b, _ in known], every, holds)


def possible(own: np.ndarray, known: Templates, limit: float) -> np.ndarray:
    """Templates that some part of a text with these bigrams may match: to reach a limit t a
    part has to hold a share of ``t / (2 - t)`` of a template, and a part of two words or
    more has no bigram that the text hasn't."""
    common = known.holds[:, np.isin(known.every, own, assume_unique=True)].sum(axis=1)
    return np.flatnonzero(common >= known.sizes * limit / (2 - limit) - 1e-9)


_BLANK = re.compile(r"\n\s*\n")


def parts(text: str) -> list[tuple[str, int, str]]:
    """Kind, number and text of every part; a paragraph of one line and a text of one
    paragraph are not given twice."""
    lines = text.split("\n")
    paragraphs = _BLANK.split(text)
    out = [("line", i, line) for i, line in enumerate(lines)]
    out += [("paragraph", i, p) for i, p in enumerate(paragraphs) if "\n" in p.strip("\n")]
    if len(paragraphs) > 1:
        out.append(("document", 0, text))
    return out


def _best(own: np.ndarray, known: Templates, among: np.ndarray, limit: float) -> tuple[float, str] | None:
    """The negative coefficient and the name of the best template that reaches the limit."""
    sizes = known.sizes[among]
    lo, hi = np.searchsorted(sizes, len(own) * limit / (2 - limit) - 1e-9), np.searchsorted(sizes, len(own) * (2 - limit) / limit + 1e-9, "right")
    best: tuple[float, str] | None = None
    for i in among[lo:hi]:
        dice = 2 * len(np.intersect1d(own, known.bigrams[i], assume_unique=True)) / (len(own) + known.sizes[i])
        if dice >= limit and (best is None or (-dice, known.names[i]) < best):
            best = (-dice, known.names[i])
    return best


def run_matches(text: str, known: Templates, among: np.ndarray, limit: float) -> list[tuple[str, float, str, int]]:
    """Runs of two or more paragraphs, not all, that reach the limit, numbered by their first
    paragraph. Of overlapping runs the best is given, the shorter of equals.

    A run is compared if a share of ``t / (2 - t)`` of its bigrams is in the templates, which
    the limit t asks for. Runs begin and end with paragraphs that hold such a bigram, as the
    others only lower the coefficient; no longer run is tried when its other bigrams are more
    than the largest template allows.
    """
    pieces = [(number, found) for number, p in enumerate(_BLANK.split(text)) if (found := words(p))]
    if len(pieces) < 3 or not len(among):
        return []
    share = limit / (2 - limit)
    ends = np.cumsum([len(found) for _, found in pieces])
    begins = ends - [len(found) for _, found in pieces]
    pairs = run_hashes(word_hashes([w for _, found in pieces for w in found]), 2)
    inside = np.isin(pairs, np.concatenate([known.bigrams[i] for i in among]))
    # a bigram across two paragraphs counts for both
    touched = [k for k in range(len(pieces)) if inside[max(begins[k] - 1, 0):ends[k]].any()]
    most = known.sizes[among].max() / share
    found = []
    for at, i in enumerate(touched):
        for j in touched[at + 1:]:
            if i == 0 and j == len(pieces) - 1:
                continue
            reach = slice(begins[i], ends[j] - 1)
            own = np.unique(pairs[reach])
            outside = len(np.unique(pairs[reach][~inside[reach]]))
            if len(own) > most or outside > most * (1 - share):
                break
            if outside <= len(own) * (1 - share) + 1e-9 and (best := _best(own, known, among, limit)):
                found.append((*best, j - i, i, j))
    out, taken = [], np.zeros(len(pieces), bool)
    for dice, name, _, i, j in sorted(found, key=lambda f: (f[0], f[2:4], f[1])):
        if not taken[i:j + 1].any():
            taken[i:j + 1] = True
            out.append((name, -dice, "run", pieces[i][0]))
    return sorted(out, key=lambda m: m[3])


def matches(text: str | None, known: Templates, limit: float) -> list[tuple[str, float, str, int]]:
    """Licence, coefficient, kind and number of every part that reaches the limit, each with
    its best template (the first name of equals)."""
    out: list[tuple[str, float, str, int]] = []
    if not len(known.sizes):
        return out
    among = possible(bigrams(text), known, limit)
    # a part of one word has a bigram of its own, that only a template of one word has
    among = np.union1d(np.flatnonzero(known.sizes == 1), among)
    if not len(among):
        return out
    for kind, number, part in parts(text or ""):
        own = bigrams(part)
        if len(own) and (best := _best(own, known, among, limit)):
            out.append((best[1], -best[0], kind, number))
    return out + run_matches(text or "", known, among, limit)


def scan(docs: DataFrame, texts: tuple[tuple[str, str], ...] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """doc_id, licenses (all found, sorted), license and dice of the best part, and ``found``,
    every part that reaches the limit with its licence. One row a document.

    Null, empty and unlicensed texts have no licence, an empty list and a coefficient of 0.
    The templates are a tuple in the program, so they are small; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(templates(texts))
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("part", pa.string()), ("number", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, uses="word hashes"):
            found = [matches(t.as_py(), known.value, limit) for t in batch.column("text")]
            best = [min(f, key=lambda m: (-m[1], m[0])) if f else (None, 0.0) for f in found]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "licenses": pa.array([sorted({m[0] for m in f}) for f in found], pa.list_(pa.string())),
                "license": pa.array([b[0] for b in best], pa.string()), "dice": pa.array([b[1] for b in best], pa.float64()),
                "found": pa.array([[dict(zip(("license", "dice", "part", "number"), m, strict=True)) for m in f] for f in found], kind)})

    slim = in_workers(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, licenses array<string>, license string, dice double, "
                                "found array<struct<license: string, dice: double, part: string, number: int>>")
