"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are cut into sentences at line ends and at sentence marks before white space; a sentence is
normalised to lower-case words, which removes comment marks. Each known licence sentence has an
identifier; the first matching pattern names the sentence. Lines that are no known sentence alone
are joined with those after them, up to a sentence mark or an empty line, where together they are a
known sentence (wrapped notices); lines that go on with an open-ended sentence belong to it. The identifiers of a text, in order, form a sequence in which
sentences that mention a licence but are not known count as ``unknown`` and all others are left
out. Ordered rules (longest notices first) consume parts of that sequence and give the licences.

Everything is local to a row: no shuffle, whatever the skew. Null and empty texts have no
sentences and give no row; repeated rows are judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text without any of these words (lower case) holds no known sentence.
ANCHOR = r"licen[sc]e|hereby granted|permission notice|endorse or promote|redistribution|warranty|spdx|public domain|\bas is\b|free software|provided that"
#: Identifier and pattern over the whole normalised sentence.
SENTENCES = (
    ("apache2_under", r"(?:.* )?licensed under the apache license version 2 0"),
    ("apache2_compliance", r"you may not use this (?:file|work) except in compliance with the license"),
    ("apache2_copy", r"you may obtain a copy of the license at(?: http.*)?"),
    ("apache2_as_is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("mit_under", r"(?:.* )?(?:released|licensed|distributed) under the (?:terms of the )?mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", r"(?:the|this) software is provided (?:by .* )?as is.*"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"(?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd_names", r"(?:3 )?neither the name .* may be used to endorse or promote products.*"),
    ("gpl3_under", r"(?:.* )?licensed under the gnu general public license version 3"),
    ("gpl2_under", r"(?:.* )?licensed under the gnu general public license version 2"),
    ("gpl_free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version ([23]) of the license or at your option any later version"),
    ("lgpl_free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license.*"),
    ("gpl_no_warranty", r"this (?:program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("mpl2_under", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc_by_nc4_under", r"(?:.* )?licensed under (?:a )?(?:cc by nc|creative commons attribution noncommercial) 4 0(?: international license)?"),
    ("cc_by_sa4_under", r"(?:.* )?licensed under (?:a )?(?:cc by sa|creative commons attribution sharealike) 4 0(?: international license)?"),
    ("cc_by4_under", r"(?:.* )?licensed under (?:a )?(?:cc by|creative commons attribution) 4 0(?: international license)?"),
    ("cc0_under", r"(?:.* )?(?:dedicated to|released into) the public domain(?: under cc0.*)?"),
    ("spdx_apache2", r"(?:.* )?spdx license identifier apache 2 0"),
    ("spdx_mit", r"(?:.* )?spdx license identifier mit"),
    ("spdx_bsd3", r"(?:.* )?spdx license identifier bsd 3 clause"),
    ("spdx_gpl3", r"(?:.* )?spdx license identifier gpl 3 0(?: only| or later)?"),
)
#: Ordered rules; each is a licence and a pattern over ``,id,,id,`` sequences.
RULES = (
    ("BSD-3-Clause", r",bsd_grant,(?:,bsd_source,)?(?:,bsd_binary,)?,bsd_names,(?:,as_is,)?"),
    ("BSD-2-Clause", r",bsd_grant,(?:,bsd_source,)?(?:,bsd_binary,)?(?:,as_is,)?"),
    ("Apache-2.0", r",apache2_under,(?:,apache2_compliance,)?(?:,apache2_copy,)?(?:,apache2_as_is,)?|,spdx_apache2,"),
    ("MIT", r"(?:,mit_under,)?,mit_grant,(?:,mit_notice,)?(?:,as_is,)?|,mit_under,|,spdx_mit,"),
    ("ISC", r",isc_grant,(?:,as_is,)?"),
    ("BSD-3-Clause", r",spdx_bsd3,"),
    ("LGPL", r",lgpl_free,(?:,gpl_no_warranty,)?"),
    ("GPL-3.0", r",gpl3_under,|,spdx_gpl3,"),
    ("GPL-2.0", r",gpl2_under,"),
    ("GPL", r",gpl_free,(?:,gpl_no_warranty,)?"),
    ("MPL-2.0", r",mpl2_under,"),
    ("CC-BY-NC-4.0", r",cc_by_nc4_under,"),
    ("CC-BY-SA-4.0", r",cc_by_sa4_under,"),
    ("CC-BY-4.0", r",cc_by4_under,"),
    ("CC0-1.0", r",cc0_under,"),
)
#: Standard wordings beside those of ``SENTENCES``.
STANDARD = (
    ("apache2_under", r"(?:.* )?licensed under the apache license version 2 0(?: the license)?(?: you may not use this (?:file|work) except in compliance with the license)?"),
    ("isc_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted.*"),
    ("gpl_free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license(?: version [23])? as published by the free software foundation(?: either version [23] of the license or at your option any later version)?"),
)
#: ``|`` marks the end of a sentence below, so texts must not have it.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz,"


def _identify(sentence: Column) -> Column:
    out = F.when(~sentence.rlike(ANCHOR), F.lit(""))
    for name, pattern in SENTENCES + STANDARD:
        out = out.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def _joined(sentence: Column) -> Column:
    """A sentence of several lines with the runs of lines that make a known sentence replaced by ``{identifier}``."""
    lines = F.transform(F.split(sentence, "\n"), lambda x: F.struct(x.alias("line"), _identify(x).alias("id")))
    out = F.array_join(F.transform(lines, lambda x: F.when(x["id"].isin("", "unknown"), x["line"]).otherwise(F.concat(F.lit("{"), x["id"], F.lit("}")))), "\n")
    known = SENTENCES + STANDARD
    for name, pattern in sorted(known, key=lambda s: s[1].endswith(".*")):  # open-ended ones take what is left
        wide = pattern.replace("(?:.* )?", "(?:[a-z0-9 ]* )?", 1) if pattern.startswith("(?:.* )?") else pattern
        wide = wide.replace(" ", "[ \n]").replace("[a-z0-9[ \n]]*[ \n]", "[a-z0-9 ]* ").replace(".*", "[a-z0-9 \n]*")
        out = F.regexp_replace(out, rf"(?<![^\n])(?:{wide})(?![^\n])", f"{{{name}}}")
    open_ended = "|".join(sorted({n for n, p in known if p.endswith(".*")}))
    return F.regexp_replace(out, rf"\{{({open_ended})\}}[a-z0-9 \n]+(?![^\n])", "{$1}")


def _identifiers(text: Column) -> Column:
    """The identifiers of a lower-case text's sentences in order, '' for those that mention no licence."""
    text = F.regexp_replace(text, r"(license, v)\. ?(?=2\.0)", "$1 ")
    text = F.regexp_replace(text, r"(a copy of the license at)[^a-z0-9]+(?=https?://)", "$1 ")
    text = F.regexp_replace(text, r"[.!?](?:[\x20\t\r]+|(?=\n)|\z)", "|")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9|\n]+", " "), r" ?([|\n]) ?", "$1"))
    sentences = F.split(F.regexp_replace(text, r"\n{2,}", "|"), r"\|")
    lines = F.flatten(F.transform(sentences, lambda s: F.when(s.contains("\n") & s.rlike(ANCHOR), F.split(_joined(s), "\n")).otherwise(F.split(s, "\n"))))
    return F.transform(lines, lambda x: F.when(x.startswith("{"), F.regexp_replace(x, "[{}]", "")).otherwise(_identify(F.trim(x))))


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with licence sentences: key, licenses and sentence_ids (in order, comma-joined), n_known, n_unknown, unmatched (known sentences that no rule used)."""
    low = F.translate(F.col(text).cast("string"), _UPPER, _LOWER)
    rows = docs.select(F.col(key), low.alias("text")).where(F.col("text").rlike(ANCHOR))
    ids = F.filter(_identifiers(F.col("text")), lambda i: i != "")
    rows = rows.select(key, ids.alias("ids")).where(F.size("ids") > 0)
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in RULES])
    sequence = F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit(","), i, F.lit(","))))
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.rlike(acc["rest"], rule["pattern"])
        found = F.when(hit & ~F.array_contains(acc["found"], rule["name"]), F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"])
        return F.struct(F.regexp_replace(acc["rest"], rule["pattern"], ";").alias("rest"), found.alias("found"))

    matched = F.aggregate(rules, start, step)
    known = F.filter("ids", lambda i: i != "unknown")
    return rows.withColumn("m", matched).select(
        key,
        F.array_join(F.array_sort("m.found"), ",").alias("licenses"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size(known).cast("long").alias("n_known"),
        (F.size("ids") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.filter(F.split("m.rest", "[,;]+"), lambda x: ~x.isin("", "unknown")), ",").alias("unmatched"),
    )
