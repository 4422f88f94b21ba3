"""License scans: sentences to identifiers, identifier sequences to licences.

A text is cut into sentences, a sentence that speaks of a licence is normalised and named by the first
sentence rule it meets, and the identifiers of a document, in order, are held against ordered licence rules.
Lines are read one by one, and lines of one sentence also joined, so that a wrapped notice is found as well.
Everything is an expression over the document's own row: no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.common import table

# Phrases of licence texts, as normalised sentences hold them. The first rule that fits names
# the sentence. Patterns use only what Java and RE2 read alike.
SENTENCE_RULES = [
    ("spdx-apache-2.0", "spdx-license-identifier apache-2.0"),
    ("spdx-mit", "spdx-license-identifier mit"),
    ("spdx-gpl-3.0", "spdx-license-identifier gpl-3.0"),
    ("spdx-gpl-2.0", "spdx-license-identifier gpl-2.0"),
    ("spdx-bsd-3", "spdx-license-identifier bsd-3-clause"),
    ("spdx-bsd-2", "spdx-license-identifier bsd-2-clause"),
    ("spdx-mpl-2.0", "spdx-license-identifier mpl-2.0"),
    ("apache-terms", "you may not use this file except in compliance with the license"),
    ("apache-warranty", "unless required by applicable law or agreed to in writing"),
    ("apache-2.0", "under (the )?(terms of the )?apache (software )?license( version)? v?2(.0)?"),
    ("lgpl-3", "gnu (lesser|library) general public license( as published by the free software foundation)?( either)?( version)? v?3"),
    ("lgpl-2.1", "gnu (lesser|library) general public license( as published by the free software foundation)?( either)?( version)? v?2"),
    ("agpl-3", "gnu affero general public license"),
    ("gpl-3", "gnu general public license( as published by the free software foundation)?( either)?( version)? v?3"),
    ("gpl-2", "gnu general public license( as published by the free software foundation)?( either)?( version)? v?2"),
    ("gpl-any", "gnu general public license"),
    ("gpl-no-warranty", "distributed in the hope that it will be useful but without any warranty"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included"),
    ("mit-as-is", "the software is provided as is without warranty of any kind"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable"),
    ("mit-name", "under (the )?(terms of the )?mit( |-)license"),
    ("isc-grant", "permission to use copy modify and( |-)?(or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-name", "under (the )?(terms of the )?isc license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-name", "neither the name of .* may be used to endorse or promote products"),
    ("bsd-as-is", "this software is provided by .* as is and any express or implied warranties"),
    ("bsd-3-named", "under (the )?(terms of the )?(bsd 3-clause|3-clause bsd|new bsd|revised bsd)( license)?"),
    ("bsd-2-named", "under (the )?(terms of the )?(bsd 2-clause|2-clause bsd|simplified bsd)( license)?"),
    ("bsd-named", "under (the |a )?(terms of the )?bsd( |-)(style )?license"),
    ("mpl-2", "mozilla public license( v.)?( version)? ?2.0"),
    ("epl", "eclipse public license"),
    ("cc0", "(cc0|creative commons zero)( 1.0)?"),
    ("cc-by-nc-sa", "(cc by-nc-sa|creative commons attribution-noncommercial-sharealike)( 4.0)?"),
    ("cc-by-nc-nd", "(cc by-nc-nd|creative commons attribution-noncommercial-noderivatives)( 4.0)?"),
    ("cc-by-nc", "(cc by-nc|creative commons attribution-noncommercial)( 4.0)?"),
    ("cc-by-sa", "(cc by-sa|creative commons attribution-sharealike)( 4.0)?"),
    ("cc-by-nd", "(cc by-nd|creative commons attribution-noderivatives)( 4.0)?"),
    ("cc-by", "(cc by|creative commons attribution)( 4.0)?"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("rights-reserved", "all rights reserved"),
    ("copyright", "copyright (c )?(holder |by )?[a-z0-9]"),
]

# Licence, the identifiers that must follow one another (others may stand between), and the
# identifiers that must not be there.
LICENSE_RULES = [
    ("Apache-2.0", ["apache-2.0"], []),
    ("Apache-2.0", ["spdx-apache-2.0"], []),
    ("Apache-2.0", ["apache-terms", "apache-warranty"], []),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"], []),
    ("MIT", ["mit-name"], []),
    ("MIT", ["spdx-mit"], []),
    ("ISC", ["isc-grant"], []),
    ("ISC", ["isc-name"], []),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], []),
    ("BSD-3-Clause", ["bsd-3-named"], []),
    ("BSD-3-Clause", ["spdx-bsd-3"], []),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], ["bsd-name"]),
    ("BSD-2-Clause", ["bsd-2-named"], []),
    ("BSD-2-Clause", ["spdx-bsd-2"], []),
    ("BSD", ["bsd-named"], []),
    ("AGPL-3.0", ["agpl-3"], []),
    ("LGPL-3.0", ["lgpl-3"], []),
    ("LGPL-2.1", ["lgpl-2.1"], []),
    ("GPL-3.0", ["gpl-3"], []),
    ("GPL-3.0", ["spdx-gpl-3.0"], []),
    ("GPL-2.0", ["gpl-2"], []),
    ("GPL-2.0", ["spdx-gpl-2.0"], []),
    ("GPL", ["gpl-any"], ["gpl-2", "gpl-3"]),
    ("MPL-2.0", ["mpl-2"], []),
    ("MPL-2.0", ["spdx-mpl-2.0"], []),
    ("EPL", ["epl"], []),
    ("CC0-1.0", ["cc0"], []),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"], []),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd"], []),
    ("CC-BY-NC-4.0", ["cc-by-nc"], []),
    ("CC-BY-SA-4.0", ["cc-by-sa"], []),
    ("CC-BY-ND-4.0", ["cc-by-nd"], []),
    ("CC-BY-4.0", ["cc-by"], []),
    ("Unlicense", ["unlicense"], []),
    ("Public-Domain", ["public-domain"], ["unlicense"]),
]

#: A sentence without any of these can't meet a rule.
KEYWORDS = "(?i)licen[cs]e|copyright|redistribut|permission|warrant|public domain|all rights|creative commons|cc by|cc0|general public|neither the name|in no event"
#: Keywords that leave a sentence without a rule worth a look by hand.
UNKNOWN = "licen[cs]e|copyright"
BLANK = r"[\x20\x09-\x0D]+"
#: KEYWORDS, however wrapped and whatever comment marks stand at the wrap.
SPREAD = KEYWORDS.replace(" ", "[^a-zA-Z0-9]+")
#: Comment marks at the begin of a line, and marks of list items.
COMMENT = r"(^|\n)[\x20\x09\x0B-\x0D]*(?:<!--|/[*]+!?|//+!?|[*]+/?|#+|--+|;+|%+|>+|(?:dnl|@?rem|REM)(?=[\x20\x09]))"
ITEM = r"\n(?=[\x20\x09]*(?:[0-9]{1,2}[.)]|[(]?[a-z0-9]{1,3}[)]|[-+\u2022])[\x20\x09])"


def _sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, f"([.!?;]){BLANK}", "$1\n"), r"\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))


def _normal(sentence: Column) -> Column:
    """Lower case; letters, digits, dots inside, plus and hyphen stay, all else is one blank."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9.+-]+", " "), "^[ .]+|[ .]+$", "")


def _pattern(phrase: str) -> str:
    """Whole words, at any place of the sentence."""
    return f"(^| )({phrase.replace('.0', '[.]0').replace(' v.', ' v[.]')})( |$)" if not phrase.endswith("[a-z0-9]") else f"(^| )({phrase})"


def _identifier(sentence: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, phrase in SENTENCE_RULES:
        out = out.when(F.regexp_like(sentence, F.lit(_pattern(phrase))), F.lit(name))
    return out.when(F.regexp_like(sentence, F.lit(UNKNOWN)), F.lit("unknown")).otherwise(F.lit(""))


def _wrapped(text: Column) -> Column:
    """Sentences over lines: lines, and parts of a line after 'v.', stay apart by one line feed in each."""
    for pattern, into in ((COMMENT, "$1"), (f"([.!?;]){BLANK}", "$1\n\n"), (r"(^|[^A-Za-z0-9])([vV][.])\n\n", "$1$2\n"), (r"\n[\x20\x09\x0B-\x0D]+(?=\n)", "\n"), (ITEM, "\n\n")):
        text = F.regexp_replace(text, pattern, into)
    return F.split(text, r"\n\n+")


def _all_identifiers(sentence: Column) -> Column:
    """Every rule that a normalised sentence meets, in order: a rule takes its words from the rules after it."""
    for name, phrase in SENTENCE_RULES:
        pattern = _pattern(phrase).removesuffix("( |$)").replace(".*", "[^|]*")
        sentence = F.regexp_replace(sentence, pattern + ("" if phrase.endswith("[a-z0-9]") else "(?= |$)"), f"$1|{name}| ")
    return F.regexp_extract_all(sentence, F.lit(r"\|([^|]+)\|"), 1)


def _identifiers(sentence: Column) -> Column:
    """Of a sentence over lines: the identifiers of its lines, or of the lines joined if that finds others."""
    lines = F.split(sentence, r"\n")
    single = F.transform(F.filter(lines, lambda s: F.regexp_like(s, F.lit(KEYWORDS))), lambda s: _identifier(_normal(s)))
    both = F.transform(F.array(F.struct(single.alias("single"), _all_identifiers(_normal(sentence)).alias("joined"))), lambda f: F.when(F.size(F.array_except(f["joined"], f["single"])) > 0, f["joined"]).otherwise(f["single"]))
    return F.when(F.regexp_like(sentence, F.lit(r"[^\n]\n+[^\n]")), both[0]).otherwise(single)


def _in_turn(names: list[str]) -> str:
    return ";" + ";([^;]+;)*".join(names) + ";"


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences, n_named, n_unknown, sentence_ids, licenses.

    n_sentences counts lines and parts of lines that end with a stop. A sentence over several lines gives the
    identifiers of its lines, or, if its lines joined meet further rules, those of the joined lines.
    sentence_ids joins the identifiers of the document in order by ';', licenses the licences found by ',' in
    the order of the rules. A null or empty text has no sentences; repeated rows give repeated results; further
    columns are not looked at; an empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    about = F.filter(_wrapped(text), lambda s: F.regexp_like(s, F.lit(SPREAD)))
    ids = F.when(F.regexp_like(text, F.lit(SPREAD)), F.flatten(F.transform(about, _identifiers))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(_sentences(text)).cast("long").alias("n_sentences"), ids.alias("ids"))
    rows = rows.select("doc_id", "n_sentences", F.filter("ids", lambda i: i != "").alias("ids"))
    rows = rows.withColumn("named", F.filter("ids", lambda i: i != "unknown"))
    turn = F.concat(F.lit(";"), F.array_join("named", ";"), F.lit(";"))
    found = F.array(*[
        F.when(F.regexp_like(F.col("turn"), F.lit(_in_turn(need))) & ~F.arrays_overlap("named", F.array(*map(F.lit, never or ["none"]))), F.lit(name)).otherwise(F.lit(""))
        for name, need, never in LICENSE_RULES
    ])
    # Most documents name no licence: the rules are not tried there.
    rows = rows.withColumn("turn", turn).withColumn("found", F.when(F.size("named") > 0, F.array_distinct(F.filter(found, lambda x: x != ""))).otherwise(F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_sentences", F.size("named").cast("long").alias("n_named"), (F.size("ids") - F.size("named")).cast("long").alias("n_unknown"),
        F.array_join("named", ";").alias("sentence_ids"), F.array_join("found", ",").alias("licenses"),
    )


def op2_license_scan(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql() -> str:
    names = " ".join(f"WHEN regexp_matches(n, {_q(_pattern(phrase))}) THEN {_q(name)}" for name, phrase in SENTENCE_RULES)
    found = ", ".join(
        f"CASE WHEN regexp_matches(turn, {_q(_in_turn(need))})" + "".join(f" AND NOT list_contains(named, {_q(x)})" for x in never) + f" THEN {_q(name)} ELSE '' END"
        for name, need, never in LICENSE_RULES
    )
    return rf"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS sentences FROM documents),
normal AS (
  SELECT doc_id, len(sentences) AS n_sentences, list_transform(list_filter(sentences, lambda s: regexp_matches(s, {_q(KEYWORDS)})),
    lambda s: regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.+-]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS normal FROM cut),
ids AS (
  SELECT doc_id, n_sentences, list_filter(list_transform(normal, lambda n: CASE {names} WHEN regexp_matches(n, {_q(UNKNOWN)}) THEN 'unknown' ELSE '' END), lambda i: i <> '') AS ids FROM normal),
named AS (SELECT *, list_filter(ids, lambda i: i <> 'unknown') AS named FROM ids),
turns AS (SELECT *, ';' || array_to_string(named, ';') || ';' AS turn FROM named),
hits AS (SELECT *, list_filter([{found}], lambda x: x <> '') AS hit FROM turns)
SELECT doc_id, n_sentences, len(named) AS n_named, len(ids) - len(named) AS n_unknown, array_to_string(named, ';') AS sentence_ids,
  array_to_string(list_filter(hit, lambda x, i: list_position(hit, x) = i), ',') AS licenses
FROM hits
"""
