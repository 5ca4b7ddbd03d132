"""Licence scans: windows of whole texts against licence templates by Dice coefficient over word bigrams.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

# Notices as their licences ask for them, openings of licence texts, and short licences as a whole.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

NORMAL = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' '))"
def needed_words(text: str, least: float) -> set[str]:
    """Words of which every text that reaches the coefficient has at least one.

    It shares at least least / (2 - least) of the template's bigrams, so words
    that touch more than the rest cannot all be absent. Long words come first.
    """
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    grams = set(zip(w, w[1:]))
    needed: set[str] = set()
    for word in sorted(set(w), key=lambda x: (-len(x), x)):
        if sum(1 for g in grams if not needed & set(g)) < len(grams) * least / (2 - least) - 1e-9:
            break
        needed.add(word)
    return needed


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def window_sizes(text: str, least: float) -> list[int]:
    """Bigrams of the windows that are compared with a template: as many as it has, and halfway to both bounds.

    2 * min(a, b) / (a + b) bounds the coefficient of sets of a and b bigrams.
    """
    n = len(words_of(text)) - 1
    return sorted({n, max(1, math.ceil(n * (1 + least / (2 - least)) / 2)), math.floor(n * (1 + (2 - least) / least) / 2)})


def _literal(values: list[str]) -> str:
    return f"array({', '.join(map(repr, values))})"  # words of a-z and 0-9 and spaces only


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: a column would be put into every place that names it and worked out each time."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, n_places, dice, start): licences whose template a window of the text reaches ``least`` with.

    The whole text is one sequence of words, lower-cased and reduced to a-z and
    0-9, whatever its lines and paragraphs are. Templates are candidates only
    where a text has one of the words that it cannot do without, and windows
    begin at a bigram of the template and have one of ``window_sizes``. dice is
    the best, start the word where the first such window begins, n_places the
    number of places: windows that begin less than a template's length apart
    are one. Every row is read once, nothing is shuffled. Null texts are empty;
    texts and templates of fewer than two words match nothing; several
    templates may match one place; null ids stay null; repeated rows give
    repeated rows.
    """
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if len(words_of(v)) > 1}
    if not templates:
        return docs.select(F.col(key).alias("doc_id"), F.lit("").alias("licence"), F.lit(0).alias("n_places"), F.lit(0.0).alias("dice"), F.lit(0).alias("start")).where("false")
    grams = {k: list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:]))) for k, w in ((k, words_of(v)) for k, v in templates.items())}
    licences_of: dict[str, list[str]] = {}
    for k, v in sorted(templates.items()):
        for word in needed_words(v, least):
            licences_of.setdefault(word, []).append(k)
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    needed = f"map({', '.join(f'{w!r}, array({", ".join(map(quoted, ks))})' for w, ks in sorted(licences_of.items()))})"
    sets = f"map({', '.join(f'{quoted(k)}, named_struct({chr(39)}grams{chr(39)}, {_literal(g)}, {chr(39)}sizes{chr(39)}, array({", ".join(map(str, window_sizes(templates[k], least)))}), {chr(39)}n{chr(39)}, {len(words_of(templates[k])) - 1})' for k, g in sorted(grams.items()))})"
    src = docs.select(F.col(key).alias("doc_id"), F.expr(f"split({NORMAL.format(f'`{text}`')}, ' ')").alias("w"))
    candidates = f"""if(coalesce(size(w), 0) < 2, cast(array() as array<string>), array_distinct(flatten(transform(
        array_intersect(w, {_literal(sorted(licences_of))}), x -> element_at({needed}, x)))))"""
    met = src.select("doc_id", "w", F.explode(F.expr(candidates)).alias("licence"))
    dice = _let("array_distinct(slice(bg, p + 1, l))", "x", "2.0D * size(array_intersect(x, t.grams)) / (size(x) + size(t.grams))")
    windows = f"""flatten(transform(filter(sequence(0, size(bg) - 1), p -> array_contains(t.grams, bg[p])), p ->
        filter(transform(t.sizes, l -> named_struct('dice', {dice}, 'start', p)), s -> s.dice >= {least - 1e-12!r}D)))"""
    bigrams = "transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))"
    places = _let("array_distinct(transform(ws, s -> s.start))", "ss", "if(size(ss) = 0, 0, size(filter(sequence(0, size(ss) - 1), k -> k = 0 or ss[k] - ss[if(k = 0, 0, k - 1)] >= t.n)))")
    found = f"if(size(ws) = 0, null, named_struct('dice', array_max(transform(ws, s -> s.dice)), 'n', {places}, 'start', element_at(ws, 1).start))"
    # The first of the best windows.
    found = found.replace("element_at(ws, 1).start", "array_min(transform(filter(ws, s -> s.dice = array_max(transform(ws, z -> z.dice))), s -> s.start))")
    whole = _let(f"element_at({sets}, licence)", "t", _let(bigrams, "bg", _let(windows, "ws", found)))
    result = met.select("doc_id", "licence", F.explode(F.expr(f"filter(array({whole}), f -> f is not null)")).alias("f"))
    return result.select("doc_id", "licence", F.col("f.n").alias("n_places"), F.col("f.dice").alias("dice"), F.col("f.start").alias("start"))
