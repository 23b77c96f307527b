"""License scan by sentence rules.

A text is cut into sentences and these at semicolons and colons into clauses; each is normalised
to lower-case letters and digits with single spaces. Every pattern of `SENTENCES` that occurs in a
sentence gives its identifier, in order of position; where patterns overlap the earlier one in the
list has the words, and a pattern may run across clauses. A clause without any that holds a
licensing keyword gives `Unknown`. The sequence of a text's identifiers is then matched against
`LATER` and `RULES` in order: a rule takes every run of identifiers equal to its own, and what it
takes is not open to later rules. "not licensed under ..." is `Negated`, which no rule takes.

Tags (`SPDX-License-Identifier:`) are read before all this, as expressions of names, OR, AND, WITH and
brackets up to the end of the expression on their line. Each name of `SPDX`, in any case, is an identifier
`Spdx:<name>` in front of the sentences' and a licence of its own: `-only` is left out, `+` of a GNU licence
is `-or-later`, an exception stays with its licence. Other names are `Unknown`. `oracle` writes the same
rules as SQL.

Everything is a column expression over one row: no shuffle, no Python. Null texts count as empty;
texts without a licensing sentence get no license. Line ends count as spaces, so wrapped sentences
are found, and text in front of or behind a known wording in its sentence does no harm. Other
columns pass through, but ones with the outputs' names are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words without which a text or sentence is not looked at.
KEYWORDS = ("licen", "copyright", "redistribut", "as is", "permission", "public domain", "warrant", "later version", "in the hope that", "endorse or promote", "all rights")
#: Parts of single words, and words that may stand on two lines; a text without any of them matches no pattern.
STEMS = ("licen", "copyright", "permission", "warrant", "redistribut", "endorse", "contributors", "misrepresented", "plainly", "altered", "creative", "cc0")
WRAPPED = r"later[^a-z0-9]+version|hope[^a-z0-9]+that|all[^a-z0-9]+rights|public[^a-z0-9]+(domain|to)|cc[^a-z0-9]+(by|zero|attribution)"
_UNDER = "(licensed|released|distributed|available|covered|published|offered) (under|by) (the terms of )?(the )?"


def _gnu(kind: str, version: str) -> str:
    """A GNU licence with its version behind the name or in front of it."""
    name = f"gnu {kind} public licen[cs]e"
    return f"({name}( as published by the free software foundation)? (either )?(version |v ?){version}( 0)?|version {version}( 0)? of the {name})"


def _cc(short: str, long: str, version: str) -> str:
    return f"(cc|creative commons) ({short}|{long}) ({version.replace('.', ' ')}|{version.replace('.', ' ')} international)"


def _cc_id(kind: str, version: str) -> str:
    return f"Cc{''.join(x.capitalize() for x in kind.split('-'))}{version.replace('.0', '').replace('.', '')}"


#: Creative Commons licences, as tags and as words, and their versions; longer names first.
CREATIVE = (
    ("BY-NC-SA", "attribution non ?commercial share ?alike"),
    ("BY-NC-ND", "attribution non ?commercial no ?deriv(ative)?s"),
    ("BY-NC", "attribution non ?commercial"),
    ("BY-SA", "attribution share ?alike"),
    ("BY-ND", "attribution no ?deriv(ative)?s"),
    ("BY", "attribution"),
)
CREATIVE_VERSIONS = ("4.0", "3.0", "2.5", "2.0")
#: Identifiers of licence sentences and how their normalised wording reads.
SENTENCES = (
    ("Negated", r"(not|never|no longer) (be )?(licensed|released|distributed|available|covered|published|offered) (under|by)(\x20[a-z0-9]+){0,8}?\x20(licen[cs]e|mit|gpl|bsd)(\x20(version\x20|v\x20?)?[0-9]+(\x20[0-9]+)?)?"),
    ("Apache2", _UNDER + r"apache (software )?(licen[cs]e )?(version |v ?)?2( 0)?( licen[cs]e)?"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"software distributed under the license is distributed on an as is basis"),
    ("ApacheSee", r"see the license for the specific language governing permissions"),
    ("MitName", r"(released|licensed|distributed|available) under (the terms of )?the mit license"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind"),
    ("Agpl3", _gnu("affero general", "3")),
    ("Lgpl21", _gnu("lesser general", "2 1")),
    ("Lgpl3", _gnu("lesser general", "3")),
    ("Lgpl2", _gnu("library general", "2")),
    ("Gfdl13", _gnu("free documentation", "1 3").replace("public ", "")),
    ("Gfdl12", _gnu("free documentation", "1 2").replace("public ", "")),
    ("Gpl2", _gnu("general", "2")),
    ("Gpl3", _gnu("general", "3")),
    ("GplLater", r"or at your option any later version"),
    ("GplHope", r"this program is distributed in the hope that it will be useful"),
    ("BsdUse", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdNames", r"may be used to endorse or promote products derived from this software"),
    ("BsdAsIs", r"this software is provided by the (copyright holders|authors?) and contributors as is"),
    *((_cc_id(k, v), _cc(k.lower().replace("-", " "), words, v)) for k, words in CREATIVE for v in CREATIVE_VERSIONS),
    ("Cc0", r"(cc0|cc zero|creative commons zero) (v ?)?1 0"),
    ("Mpl2", r"mozilla public licen[cs]e (version |v ?)?2 0"),
    ("Mpl11", r"mozilla public licen[cs]e (version |v ?)?1 1"),
    ("Epl2", r"eclipse public licen[cs]e (version |v ?)?2 0"),
    ("Epl1", r"eclipse public licen[cs]e (version |v ?)?1 0"),
    ("Boost", r"boost software licen[cs]e (version |v ?)?1 0"),
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("ZlibAltered", r"altered source versions must be plainly marked as such"),
    ("ZlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("ZlibName", _UNDER + r"zlib( libpng)? licen[cs]e"),
    ("Cddl11", r"common development and distribution licen[cs]e (version |v ?)?1 1"),
    ("Cddl1", r"common development and distribution licen[cs]e (version |v ?)?1 0"),
    ("Artistic2", r"artistic licen[cs]e (version |v ?)?2 0"),
    ("Ofl11", r"sil open font licen[cs]e (version |v ?)?1 1"),
    ("Eupl12", r"european union public licen[cs]e (version |v ?)?1 2"),
    ("Wtfpl", r"do what the fuck you want to public licen[cs]e"),
    ("Bsd3Name", _UNDER + r"(3 clause|new|modified|revised) bsd licen[cs]e"),
    ("Bsd3Name", _UNDER + r"bsd 3 clause( licen[cs]e)?"),
    ("Bsd2Name", _UNDER + r"(2 clause|simplified|freebsd) (bsd )?licen[cs]e"),
    ("Bsd2Name", _UNDER + r"bsd 2 clause( licen[cs]e)?"),
    ("IscName", _UNDER + r"isc licen[cs]e"),
    ("UnlicenseName", _UNDER + r"unlicense"),
    ("Isc", r"permission to use copy modify and or distribute this software for any purpose"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("Reserved", r"all rights reserved"),
)
#: Licenses and the identifier sequences that grant them, in the order they are tried.
RULES = (
    ("Apache-2.0", ("Apache2", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("Apache2", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("Apache2",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitName",)),
    ("AGPL-3.0", ("Agpl3",)),
    ("LGPL-2.1", ("Lgpl21",)),
    ("LGPL-3.0", ("Lgpl3",)),
    ("GPL-2.0-or-later", ("Gpl2", "GplLater")),
    ("GPL-3.0-or-later", ("Gpl3", "GplLater")),
    ("GPL-2.0", ("Gpl2",)),
    ("GPL-3.0", ("Gpl3",)),
    ("BSD-3-Clause", ("BsdUse", "BsdSource", "BsdBinary", "BsdNames", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdUse", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("LGPL-2.0", ("Lgpl2",)),
    ("GFDL-1.3", ("Gfdl13",)),
    ("GFDL-1.2", ("Gfdl12",)),
    ("BSD-3-Clause", ("Bsd3Name",)),
    ("BSD-2-Clause", ("Bsd2Name",)),
    ("Zlib", ("ZlibAsIs", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    ("Zlib", ("ZlibName",)),
    *((f"CC-{k}-{v}", (_cc_id(k, v),)) for k, _ in CREATIVE for v in CREATIVE_VERSIONS),
    ("CC0-1.0", ("Cc0",)),
    ("MPL-2.0", ("Mpl2",)),
    ("MPL-1.1", ("Mpl11",)),
    ("EPL-2.0", ("Epl2",)),
    ("EPL-1.0", ("Epl1",)),
    ("BSL-1.0", ("Boost",)),
    ("CDDL-1.1", ("Cddl11",)),
    ("CDDL-1.0", ("Cddl1",)),
    ("Artistic-2.0", ("Artistic2",)),
    ("OFL-1.1", ("Ofl11",)),
    ("EUPL-1.2", ("Eupl12",)),
    ("WTFPL", ("Wtfpl",)),
    ("ISC", ("IscName",)),
    ("Unlicense", ("UnlicenseName",)),
    ("ISC", ("Isc",)),
    ("Unlicense", ("Unlicense",)),
)
#: Rules over both halves of a notice, tried before `RULES`.
LATER = (("AGPL-3.0-or-later", ("Agpl3", "GplLater")), ("LGPL-2.0-or-later", ("Lgpl2", "GplLater")), ("LGPL-2.1-or-later", ("Lgpl21", "GplLater")), ("LGPL-3.0-or-later", ("Lgpl3", "GplLater")))
#: Names that a tag may hold, without `-only`, `-or-later` and `+`, and exceptions behind WITH.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-1.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "APSL-2.0", "Artistic-1.0", "Artistic-2.0",
    "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear",
    "BSD-3-Clause-LBNL", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "bzip2-1.0.6",
    *(f"CC-{k}-{v}" for k, _ in CREATIVE for v in CREATIVE_VERSIONS), "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0",
    "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "HPND", "ICU", "IJG", "IPL-1.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "Libpng", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.0", "MPL-1.1",
    "MPL-2.0", "MPL-2.0-no-copyleft-exception", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.0", "OFL-1.1", "OpenSSL",
    "OSL-3.0", "PDDL-1.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "Ruby", "SSPL-1.0", "Unicode-DFS-2016", "Unlicense",
    "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
EXCEPTIONS = ("Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "Font-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception", "OpenJDK-assembly-exception-1.0")
#: A name, and a whole tag with its expression as group 1; both dialects of patterns read them alike.
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?"
_ATOM = rf"{_NAME}(?:[ \t]+WITH[ \t]+{_NAME})?"
_TAG = rf"(?i:SPDX-License-Identifier):[ \t(]*({_ATOM}(?:[ \t)]+(?:OR|AND)[ \t(]+{_ATOM})*)"
_CUT, _CLAUSE = "\x01", "\x02"


def _any(text: Column, parts: tuple[str, ...] = KEYWORDS) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in parts])


def clauses(text: Column) -> Column:
    """Normalised clauses of a text in lower case, as an array; `<Name>` in place of what a pattern matched."""
    plain = F.regexp_replace(F.replace(text, F.lit(_CLAUSE), F.lit(" ")), r"\bv\.\s+", "v ")  # "v. 2.0" ends no sentence
    cut = F.regexp_replace(F.regexp_replace(plain, r"[.!?]\s+", _CUT), r"[;:]\s+", _CLAUSE)
    flat = F.regexp_replace(F.regexp_replace(cut, f"[^a-z0-9{_CUT}{_CLAUSE}]+", " "), f" ?([{_CUT}{_CLAUSE}]) ?", "$1")
    for known, pattern in SENTENCES:
        flat = F.regexp_replace(flat, rf"\b(?:{pattern.replace(' ', f'[ {_CLAUSE}]')})\b", f"<{known}>")
    return F.split(flat, f"[{_CUT}{_CLAUSE}]")


def _spdx_names() -> dict[str, str]:
    """What may stand in a tag, in lower case, and the licence that it names."""
    names = {}
    for name in SPDX:
        names[name.lower()] = name
        names[name.lower() + "+"] = f"{name}+"
        if name.split("-")[0] in ("AGPL", "GFDL", "GPL", "LGPL"):
            names |= {f"{name}-only".lower(): name, f"{name}-or-later".lower(): f"{name}-or-later", f"{name}+".lower(): f"{name}-or-later"}
    return names


def tags(text: Column) -> Column:
    """Identifiers of a text's tags in order: `Spdx:<licence>`, or `Unknown`."""
    known = F.create_map(*[F.lit(x) for pair in _spdx_names().items() for x in pair])
    beside = F.create_map(*[F.lit(x) for e in EXCEPTIONS for x in (e.lower(), e)])
    atoms = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_TAG), F.lit(1)), lambda e: F.split(e, r"[ \t)]+(?:OR|AND)[ \t(]+")))

    def named(atom: Column) -> Column:
        parts = F.split(F.lower(atom), r"[ \t]+with[ \t]+")
        exception = F.get(parts, F.lit(1))
        name = F.concat(known[F.get(parts, F.lit(0))], F.when(exception.isNull(), F.lit("")).otherwise(F.concat(F.lit(" WITH "), beside[exception])))
        return F.coalesce(F.concat(F.lit("Spdx:"), name), F.lit("Unknown"))

    return F.transform(atoms, named)


def _tagged(text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), F.lit(False))


def _prose(text: Column) -> Column:
    """A text in lower case without its tags; empty for null."""
    return F.coalesce(F.lower(F.when(_tagged(text), F.regexp_replace(text, _TAG, ". ")).otherwise(text)), F.lit(""))


def identifiers(text: Column, prose: Column | None = None) -> Column:
    """Identifiers of a text's tags, then of its licensing sentences, each in order, as an array."""

    def names(s: Column) -> Column:
        unknown = F.when(_any(s), F.array(F.lit("Unknown"))).otherwise(F.array().cast("array<string>"))
        return F.when(F.contains(s, F.lit("<")), F.regexp_extract_all(s, F.lit("<([A-Za-z0-9]+)>"), F.lit(1))).otherwise(unknown)

    none = F.array().cast("array<string>")
    low = _prose(text) if prose is None else prose
    found = F.flatten(F.transform(clauses(low), names))
    # Keywords of two words count on one line only, patterns across lines as well.
    in_words = F.when(_any(low), found).when(_any(low, STEMS) | F.rlike(low, F.lit(WRAPPED)), F.filter(found, lambda s: s != "Unknown")).otherwise(none)
    return F.concat(F.when(_tagged(text), tags(text)).otherwise(none), in_words)


def scan(df: DataFrame, text_col: str = "text", out_col: str = "licenses", ids_col: str = "sentence_ids", rest_col: str = "unmatched") -> DataFrame:
    """Adds the licenses of each text in rule order, its identifiers, and how many no rule took."""
    clash = (max(map(len, df.columns)) + 1) * "_"  # longer than any column, so that none of them is taken
    made = df.withColumn(clash, _prose(F.col(text_col)))  # a column of its own, so that it is made once
    made = made.withColumn(ids_col, identifiers(F.col(text_col), F.col(clash))).drop(clash)
    tag = lambda s: s.startswith("Spdx:")
    left = F.array_join(F.transform(F.filter(ids_col, lambda s: ~tag(s)), lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    names = []
    for k, (license_, rule) in enumerate(LATER + RULES):
        wanted = "".join(f"<{s}>" for s in rule)
        made = made.withColumns({f"{clash}{k}": left})
        names.append(F.when(F.contains(F.col(f"{clash}{k}"), F.lit(wanted)), F.lit(license_)))
        left = F.replace(F.col(f"{clash}{k}"), F.lit(wanted), F.lit("|"))  # keeps what stood apart from joining up
    tagged = F.transform(F.filter(ids_col, tag), lambda s: F.substring(s, 6, 2**31 - 1))
    made = made.withColumns({out_col: F.array_distinct(F.concat(F.array_compact(F.array(*names)), tagged)), rest_col: F.regexp_count(left, F.lit("<")).cast("long")})
    return made.drop(*[f"{clash}{k}" for k in range(len(LATER + RULES))])


def oracle(table: str, id_col: str = "doc_id") -> str:
    """The same scan of the text column of `table`, by the same rules, as one DuckDB query."""
    has = lambda x, parts=KEYWORDS: "(" + " OR ".join(f"contains({x}, '{k}')" for k in parts) + ")"
    cut, clause = f"chr({ord(_CUT)})", f"chr({ord(_CLAUSE)})"
    either = rf"[\x{ord(_CUT):02x}\x{ord(_CLAUSE):02x}]"
    flat = f"replace(low, {clause}, ' ')"
    for pattern, new in ((r"'\bv\.\s+'", "'v '"), (r"'[.!?]\s+'", cut), (r"'[;:]\s+'", clause), (f"'[^a-z0-9{either[1:]}+'", "' '"), (f"' ?({either}) ?'", r"'\1'")):
        flat = f"regexp_replace({flat}, {pattern}, {new}, 'g')"
    for known, pattern in SENTENCES:
        flat = f"regexp_replace({flat}, '" + rf"\b(?:{pattern.replace(' ', rf'[ \x{ord(_CLAUSE):02x}]')})\b" + f"', '<{known}>', 'g')"
    split = r"[ \t)]+(?:OR|AND)[ \t(]+"
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _spdx_names().items()) + "}"
    exceptions = "MAP {" + ", ".join(f"'{e.lower()}': '{e}'" for e in EXCEPTIONS) + "}"
    parts = r"string_split_regex(lower(a), '[ \t]+with[ \t]+')"
    tag = f"coalesce('Spdx:' || {names}[{parts}[1]] || CASE WHEN len({parts}) = 1 THEN '' ELSE ' WITH ' || {exceptions}[{parts}[2]] END, 'Unknown')"
    steps, left = [], "array_to_string(list_transform(list_filter(ids, lambda s: NOT starts_with(s, 'Spdx:')), lambda s: '<' || s || '>'), '')"
    licences = []
    for k, (license_, rule) in enumerate(LATER + RULES):
        wanted, before = "".join(f"<{s}>" for s in rule), "ids0" if not k else f"step{k - 1}"
        steps.append(f"step{k} AS (SELECT *, {left} AS left{k} FROM {before})")
        licences.append(f"CASE WHEN contains(left{k}, '{wanted}') THEN '{license_}' END")
        left = f"replace(left{k}, '{wanted}', '|')"
    return f"""
WITH low AS (SELECT {id_col}, lower(regexp_replace(coalesce(text, ''), '{_TAG}', '. ', 'g')) AS low,
        list_transform(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '{_TAG}', 1), lambda e: string_split_regex(e, '{split}'))), lambda a: {tag}) AS tags FROM {table}),
cut AS (SELECT {id_col}, low, tags, string_split_regex({flat}, '{either}') AS clauses FROM low),
found AS (SELECT {id_col}, low, tags, flatten(list_transform(clauses, lambda s: CASE WHEN contains(s, '<') THEN regexp_extract_all(s, '<([A-Za-z0-9]+)>', 1)
        WHEN {has('s')} THEN ['Unknown'] ELSE []::VARCHAR[] END)) AS found FROM cut),
ids0 AS (SELECT {id_col}, list_concat(tags, CASE WHEN {has('low')} THEN found WHEN {has('low', STEMS)} OR regexp_matches(low, '{WRAPPED}') THEN list_filter(found, lambda s: s <> 'Unknown') ELSE []::VARCHAR[] END) AS ids FROM found),
{", ".join(steps)},
named AS (SELECT *, list_concat(list_filter([{", ".join(licences)}], lambda x: x IS NOT NULL),
        list_transform(list_filter(ids, lambda s: starts_with(s, 'Spdx:')), lambda s: substr(s, 6))) AS named, length({left}) - length(replace({left}, '<', '')) AS unmatched
FROM step{len(LATER + RULES) - 1})
SELECT {id_col}, array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i), ',') AS licenses,
       array_to_string(ids, ',') AS sentence_ids, unmatched FROM named"""
