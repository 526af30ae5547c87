"""License scanning by MinHash bands over overlapping text windows. DataFrame functions only.

Texts and templates become words (letters and digits, lower case), words become 3-word shingles, and windows of
`window` shingles that overlap by half become `bands` minima of one hash each. A template's windows start at every
shingle, so a document window that lies inside an unchanged template passage has a template window of the same
shingles and shares every band with it; two windows of similarity s share a band with probability
1 - (1 - s) ** bands. The templates' band keys are a fixed, small table. A template that a window retrieves is
verified exactly: the share of its distinct shingles that the document holds must reach `percent`.

Defined results: null and empty text, and text of fewer words than a shingle, match nothing and have no row; rows
without doc_id are scanned like others; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberlode.llm.common import let

#: Short forms, opening passages and whole texts of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3-clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-full": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


@dataclass(frozen=True)
class Params:
    """`window` must be even; half of it is the stride. `most_chars`: all templates together, which are broadcast."""

    shingle: int = 3
    window: int = 4
    bands: int = 8
    percent: int = 80
    most_chars: int = 4_000_000


def _seeds(p: Params) -> list[int]:
    """One odd multiple of a fixed odd number for each band, as a signed long."""
    return [((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) - (1 << 63) for k in range(p.bands)]


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, p: Params) -> Column:
    """A 64-bit hash for each run of `shingle` words, in order."""
    return F.when(F.size(words) < p.shingle, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - p.shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(p.shingle)]))
    )


def band_keys(hashes: Column, p: Params, stride: int) -> Column:
    """The band keys of the windows that start at every `stride`-th shingle; a last window may be short.

    A band's hash of x is x ^ seed, and the least one's x ^ seed is the key: a key names its band."""

    def window(i: Column) -> Column:
        parts = [F.get(hashes, i + k) for k in range(p.window)]
        return F.array(*[F.least(*[x.bitwiseXOR(F.lit(s)) for x in parts]) for s in _seeds(p)])

    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - p.window + stride - 1, F.lit(0)), F.lit(stride))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(starts, window)))


def templates(spark, p: Params, texts: dict[str, str]) -> DataFrame:
    """license, t_hashes (distinct) and keys of every template."""
    rows = spark.createDataFrame(list(texts.items()), "license string, template string")
    hashed = rows.select("license", let(normal_words(F.col("template")), lambda w: shingle_hashes(w, p)).alias("h"))
    return hashed.select("license", F.array_distinct("h").alias("t_hashes"), F.array_distinct(band_keys(F.col("h"), p, 1)).alias("keys")).where(F.size("t_hashes") > 0)


def licenses(docs: DataFrame, p: Params = Params(), texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, n_shingles (of the template), n_found and containment (4 places): a row for every row of `docs`
    and template that it holds. Documents are read once and not shuffled; a template that several windows retrieve is
    verified once."""
    longest = sum(map(len, texts.values()))
    if longest > p.most_chars:  # the templates travel to every executor
        raise ValueError(f"templates of {longest} characters, over the {p.most_chars} that may be broadcast")
    known = templates(docs.sparkSession, p, texts)
    # one row that every document meets: all band keys, and the templates by license
    book = known.agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("wanted"), F.array_sort(F.collect_list(F.struct("license", "t_hashes", "keys"))).alias("book"))
    hashes = let(normal_words(F.col("text")), lambda w: shingle_hashes(w, p))

    def found(h: Column) -> Column:
        keys = F.array_intersect(band_keys(h, p, p.window // 2), F.col("wanted"))
        retrieved = let(keys, lambda k: F.when(F.size(k) > 0, F.filter("book", lambda t: F.arrays_overlap(t["keys"], k))))
        return F.transform(retrieved, lambda t: F.struct(t["license"].alias("license"), F.size(t["t_hashes"]).cast("long").alias("n"), F.size(F.array_intersect(t["t_hashes"], h)).cast("long").alias("k")))

    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(book)).select("doc_id", let(hashes, found).alias("found"))
    good = met.where(F.size("found") > 0).select("doc_id", F.explode("found").alias("x")).where(100 * F.col("x.k") >= p.percent * F.col("x.n"))
    return good.select("doc_id", "x.license", F.col("x.n").alias("n_shingles"), F.col("x.k").alias("n_found"), F.round(F.col("x.k") / F.col("x.n"), 4).alias("containment"))
