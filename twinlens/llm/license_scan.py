"""License scans: ordered signature rules with keyword gates and interval suppression.

A rule is ``(label, kind, keywords, pattern, confidence, anchors)``.  Texts are
folded to lower-case words joined by single spaces, so a pattern sees neither
punctuation nor line breaks.  A rule is looked at only when the folded text holds
one of its anchors (words of the form) and one of its keywords (words of the
name); each way to match the pattern holds one of both, so no gate hides a match.
Detections are intervals; one
that lies inside an interval of a better kind (or inside a longer one of its
own kind) is suppressed.  All of it is built-in expressions on one row: no
join, no shuffle, no user function.

Defined results: null text counts as empty (0 words, no labels, score 0); null
or repeated ids and extra columns pass through; equal intervals of one kind
keep the one whose rule comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Base phrases and their labels (fixed values).
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"),
        (("general", "public", "license"), "gpl")]
# Kinds in order of priority: the first wins.
KINDS = ["identifier", "grant", "notice", "title", "hint"]
CONFIDENCE = {"identifier": 0.99, "grant": 0.95, "notice": 0.9, "title": 0.8, "hint": 0.5}

# label: (keywords, name pattern); names as they read after folding, short names and SPDX
# ids among them.  Each alternative of a pattern holds a keyword (fixed values).
FAMILIES = {
    "0bsd": (["bsd"], r"(?:0bsd|zero clause bsd|bsd 0 clause)"),
    "afl-3.0": (["academic free", "afl"], r"(?:academic free|afl)"),
    "agpl-3.0": (["affero general public", "agpl"], r"(?:gnu )?(?:affero general public|agpl(?:v\d)?)"),
    "apache-1.1": (["apache"], r"apache(?: software)? (?:license )?(?:version )?1 1"),
    "apache-2.0": (["apache"], r"apache(?: software)?"),
    "artistic-2.0": (["artistic"], r"artistic"),
    "bsd-2-clause": (["bsd"], r"(?:bsd 2 clause|simplified bsd|freebsd|2 clause bsd)"),
    "bsd-3-clause": (["bsd"], r"(?:bsd 3 clause|new bsd|revised bsd|modified bsd|3 clause bsd)"),
    "bsd-4-clause": (["bsd"], r"(?:bsd 4 clause|original bsd|4 clause bsd)"),
    "bsd": (["berkeley software distribution", "bsd"], r"(?:berkeley software distribution|bsd(?: style)?)"),
    "bsl-1.0": (["boost software", "bsl 1"], r"(?:boost software|bsl 1)"),
    "busl-1.1": (["business source", "busl"], r"(?:business source|busl)"),
    "cc0-1.0": (["cc0", "cc zero", "creative commons zero"], r"(?:cc0|cc zero|creative commons (?:zero|cc0))"),
    "cc-by": (["cc by", "creative commons attribution"], r"(?:cc by|creative commons attribution)(?! (?:nc|nd|sa|non|no|share)\b)"),
    "cc-by-nc": (["cc by", "creative commons attribution"], r"(?:cc by nc|creative commons attribution non ?commercial)(?! (?:nd|sa|no|share)\b)"),
    "cc-by-nc-nd": (["cc by", "creative commons attribution"], r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)"),
    "cc-by-nc-sa": (["cc by", "creative commons attribution"], r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)"),
    "cc-by-nd": (["cc by", "creative commons attribution"], r"(?:cc by nd|creative commons attribution no ?deriv\w*)"),
    "cc-by-sa": (["cc by", "creative commons attribution"], r"(?:cc by sa|creative commons attribution share ?alike)"),
    "cddl": (["common development and distribution", "cddl"], r"(?:common development and distribution|cddl)"),
    "cecill": (["cecill"], r"cecill"),
    "cpl-1.0": (["common public", "cpl"], r"(?:common public|cpl)"),
    "ecl-2.0": (["educational community", "ecl"], r"(?:educational community|ecl)"),
    "epl": (["eclipse public", "epl"], r"(?:eclipse public|epl(?:v\d)?)"),
    "eupl": (["european union public", "eupl"], r"(?:european union public|eupl)"),
    "gfdl": (["free documentation", "fdl"], r"(?:gnu )?(?:free documentation|g?fdl(?:v\d)?)"),
    "gpl": (["general public", "gpl"], r"(?:gnu )?(?:(?<!lesser )(?<!library )(?<!affero )general public|gpl(?:v\d)?)"),
    "isc": (["isc"], r"isc"),
    "json": (["json"], r"json"),
    "lgpl": (["lesser general public", "library general public", "lgpl"], r"(?:gnu )?(?:(?:lesser|library) general public|lgpl(?:v\d)?)"),
    "lppl": (["latex project public", "lppl"], r"(?:latex project public|lppl)"),
    "mit": (["mit", "expat"], r"(?:mit|expat)"),
    "mit-0": (["mit"], r"mit (?:0|no attribution)"),
    "mpl": (["mozilla public", "mpl"], r"(?:mozilla public|mpl(?:v\d)?)"),
    "ms-pl": (["microsoft public", "ms pl"], r"(?:microsoft public|ms pl)"),
    "ms-rl": (["microsoft reciprocal", "ms rl"], r"(?:microsoft reciprocal|ms rl)"),
    "ncsa": (["illinois", "ncsa"], r"(?:(?:university of )?illinois(?: ncsa)? open source|ncsa)"),
    "odbl": (["open database", "odbl"], r"(?:open data commons open database|odbl)"),
    "ofl-1.1": (["open font", "ofl"], r"(?:sil )?(?:open font|ofl)"),
    "openssl": (["openssl"], r"openssl"),
    "osl-3.0": (["open software", "osl"], r"(?:open software|osl)"),
    "pddl": (["public domain dedication", "pddl"], r"(?:public domain dedication|pddl)"),
    "php": (["php"], r"php"),
    "postgresql": (["postgresql"], r"postgresql"),
    "psf": (["python software foundation", "psf"], r"(?:python software foundation|psf)"),
    "ruby": (["ruby"], r"ruby"),
    "sspl": (["server side public", "sspl"], r"(?:server side public|sspl)"),
    "unlicense": (["unlicense"], r"(?:the )?unlicense"),
    "upl": (["universal permissive", "upl"], r"(?:universal permissive|upl)"),
    "vim": (["vim"], r"vim"),
    "wtfpl": (["wtfpl", "do what the"], r"(?:wtfpl|do what the \w+ you want to public)"),
    "zlib": (["zlib"], r"(?:zlib|zlib libpng)"),
    "zpl": (["zope public", "zpl"], r"(?:zope public|zpl)"),
}
_VERSION = r"(?: (?:license )?(?:version |v ?)?\d+(?: \d+)?(?: or (?:any )?later(?: version)?)?| license)*"
_BY = "(?:the )?(?:terms of )?(?:the )?"
# How a family is named in running text: (kind, anchors, pattern), each makes one rule a
# family.  Each alternative of a pattern holds an anchor.
FORMS = [
    ("identifier", ["spdx license identifier"], r"\bspdx license identifier {name}" + _VERSION),
    ("grant", ["licensed under", "licenced under"], r"\b(?:re)?licen[sc]ed under " + _BY + "{name}" + _VERSION),
    ("grant", ["released under", "distributed under", "available under", "published under", "provided under"],
     r"\b(?:released|distributed|available|published|provided) under " + _BY + "{name}" + _VERSION),
    ("notice", ["subject to", "governed by", "according to", "covered by"],
     r"\b(?:subject to|governed by|according to|covered by) " + _BY + "{name}" + _VERSION),
    ("title", [" license", " licence"], r"\b{name} licen[sc]e" + _VERSION),
]
# Rules on the wording of the licence texts themselves (fixed values).
WORDING = [
    ("mit", "notice", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "notice", "permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose"),
    ("bsd", "notice", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("apache-2.0", "notice", "apache", r"apache org licenses license 2 0"),
    ("gpl", "notice", "free software", r"this program is free software you can redistribute it and or modify it"),
    ("lgpl", "notice", "free software", r"this library is free software you can redistribute it and or modify it"),
    ("unlicense", "notice", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("zlib", "notice", "as is", r"this software is provided as is without any express or implied warranty in no event"),
    ("mpl", "notice", "mozilla", r"subject to the terms of the mozilla public license"),
    ("cc", "hint", "creativecommons", r"creativecommons org licenses [a-z]+(?: [a-z]+)*"),
    ("public-domain", "hint", "public domain", r"(?:in|into|to) the public domain"),
    ("proprietary", "hint", "all rights reserved", r"all rights reserved"),
    ("copyright", "hint", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]


@dataclass(frozen=True)
class Signature:
    label: str
    kind: str
    keyword: str | tuple[str, ...]      # one of them is in every match ("" is in any text)
    pattern: str
    confidence: float
    anchors: tuple[str, ...] = ("",)    # and one of these


def signatures() -> list[Signature]:
    """The ordered rule list: every family in every form, then the wordings."""
    out = [Signature(label, kind, tuple(keywords), form.replace("{name}", name) + r"\b", CONFIDENCE[kind], tuple(anchors))
           for kind, anchors, form in FORMS for label, (keywords, name) in FAMILIES.items()]
    out += [Signature(label, kind, keyword, rf"\b{pattern}\b", CONFIDENCE[kind], (keyword,))
            for label, kind, keyword, pattern in WORDING]
    return sorted(out, key=lambda s: KINDS.index(s.kind))


RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def _rules_literal(rules: list[Signature], forms: list[tuple[str, ...]]) -> Column:
    words = [(s.keyword,) if isinstance(s.keyword, str) else s.keyword for s in rules]
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(KINDS.index(s.kind)).alias("kind"),
                              F.lit(s.label).alias("label"), F.array(*map(F.lit, words[i])).alias("keywords"),
                              F.lit(forms.index(s.anchors)).alias("form"),
                              F.lit(s.pattern).alias("pattern"), F.lit(s.confidence).alias("confidence"))
                     for i, s in enumerate(rules)])


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


# Start and end of every match of a pattern: lengths of the gaps and matches before it.
_INTERVALS = (
    "aggregate(sequence(1, size(m)), named_struct('at', 0, 'found', CAST(array() AS array<struct<s:int,e:int>>)), "
    "(a, k) -> named_struct('at', a.at + length(element_at(g, k)) + length(element_at(m, k)), 'found', "
    "array_append(a.found, named_struct('s', a.at + length(element_at(g, k)), "
    "'e', a.at + length(element_at(g, k)) + length(element_at(m, k))))), a -> a.found)")


def scan(df: DataFrame, text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """Input columns plus n_words, n_base, first_word, last_word, base_labels,
    labels, score and ``detections`` (the surviving label, kind, matched text,
    confidence, start, end - offsets in the folded text)."""
    rules = signatures() if rules is None else rules
    return beside(df, text, lambda d: _scan(d, rules), RESULTS)


def _scan(d: DataFrame, rules: list[Signature]) -> DataFrame:
    forms = list(dict.fromkeys(s.anchors for s in rules))
    d = d.withColumn("_bw", F.filter(F.split(F.translate("text", UPPER, LOWER), NON_WORD), lambda w: w != F.lit("")))
    d = d.withColumns({"n_words": F.size("_bw").cast("long"),
                       "_norm": F.concat(F.lit(" "), F.array_join("_bw", " "), F.lit(" "))})
    d = d.withColumn("_forms", F.array(*[_any_of(F.col("_norm"), words) for words in forms]))
    places = {}
    for phrase, label in BASE:
        cond = " AND ".join(f"get(_bw, i + {j}) = '{w}'" if j else f"_bw[i] = '{w}'" for j, w in enumerate(phrase))
        places[f"_b_{label}"] = F.expr(
            f"CASE WHEN contains(_norm, ' {' '.join(phrase)} ') THEN "
            f"filter(sequence(0, size(_bw) - 1), i -> {cond}) ELSE CAST(array() AS array<int>) END")
    d = d.withColumns(places | {"_rules": F.when(F.array_contains("_forms", True), F.filter(
        _rules_literal(rules, forms), lambda r: F.get("_forms", r["form"]) & F.exists(
            r["keywords"], lambda w: F.contains(F.col("_norm"), w))))})
    # matches of each gated rule, then their places
    d = d.withColumn("_hits", F.expr(
        "filter(transform(_rules, r -> named_struct('r', r, 'm', regexp_extract_all(_norm, r.pattern, 0))), "
        "x -> size(x.m) > 0)"))
    d = d.withColumn("_parts", F.expr(
        "transform(_hits, x -> named_struct('r', x.r, 'm', x.m, 'g', split(_norm, x.r.pattern, -1)))"))
    intervals = _INTERVALS.replace("(m)", "(x.m)").replace("(g, k)", "(x.g, k)").replace("(m, k)", "(x.m, k)")
    d = d.withColumn("_dets", F.expr(
        "sort_array(flatten(transform(_parts, x -> transform(" + intervals + ", p -> named_struct("
        "'s', p.s, 'neg_e', -p.e, 'kind', x.r.kind, 'rule', x.r.rule, 'label', x.r.label, "
        "'confidence', x.r.confidence)))))"))
    # Sorted by start, longest first, better kind first, whatever can suppress a detection
    # stands before it: the running largest end of each kind decides.
    best = ", ".join(f"'e{k}', -1" for k in range(len(KINDS)))
    inside = " OR ".join(f"(d.kind >= {k} AND a.e{k} >= -d.neg_e)" for k in range(len(KINDS)))
    step = ", ".join(f"'e{k}', CASE WHEN d.kind = {k} THEN greatest(a.e{k}, -d.neg_e) ELSE a.e{k} END"
                     for k in range(len(KINDS)))
    fold = ("aggregate(_dets, named_struct(" + best + ", 'kept', CAST(array() AS array<int>), 'i', 0), "
            "(a, d) -> named_struct(" + step + ", 'kept', CASE WHEN " + inside
            + " THEN a.kept ELSE array_append(a.kept, a.i) END, 'i', a.i + 1), a -> a.kept)")
    d = d.withColumn("_kept", F.expr(fold))
    d = d.withColumn("detections", F.expr(
        "coalesce(transform(_kept, i -> named_struct('label', _dets[i].label, 'rule', _dets[i].rule, "
        "'kind', _dets[i].kind, 'start', _dets[i].s, 'end', -_dets[i].neg_e, 'confidence', _dets[i].confidence, "
        "'matched', trim(substring(_norm, _dets[i].s + 1, -_dets[i].neg_e - _dets[i].s)))), array())"))
    all_places = F.array_sort(F.concat(*[F.col(c) for c in places]))
    empty = F.array().cast("array<string>")
    d = d.withColumns({
        "_places": F.coalesce(all_places, F.array().cast("array<int>")),
        "_base": F.filter(F.array(*[F.when(F.size(f"_b_{label}") > 0, F.lit(label))
                                    for label in sorted(x for _, x in BASE)]), lambda x: x.isNotNull()),
        "_method": F.coalesce(F.transform("detections", lambda x: x["label"]), empty),
    })
    return d.withColumns({
        "n_base": F.size("_places").cast("long"),
        "first_word": F.get("_places", F.lit(0)).cast("long"),
        "last_word": F.get("_places", F.size("_places") - 1).cast("long"),
        "base_labels": F.array_join("_base", ","),
        "labels": F.array_join(F.array_sort(F.array_union("_base", "_method")), ","),
        "score": F.greatest(F.when(F.size("_base") > 0, F.lit(0.8)).otherwise(F.lit(0.0)),
                            F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))),
    })
