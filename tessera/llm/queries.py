"""Queries over training text, by problem number, and SQL where SQL can state them over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.chars import COMPOSED, INVISIBLE, PERSIAN_DIGITS, PLAIN_CLASS, one_to_one
from tessera.llm import bpe, confusables, cutoff, neardup, packing, pii, repetition
from tessera.session import table

# Types that the found query asks for; cards and IBANs are found as well.
LISTING_TYPES = ("phone", "email", "national_id", "address", "person")

QUERIES = {
    "p2_found": lambda s, d: cutoff.truncated(table(s, d, "listing")),
    "p2_source_share": lambda s, d: cutoff.source_report(table(s, d, "listing")),
    "p4_found": lambda s, d: pii.find(table(s, d, "listing")).where(F.col("pii_type").isin(*LISTING_TYPES)).select("listing_id", "pii_type", "mention_no"),
    "p4_redacted": lambda s, d: pii.redacted(table(s, d, "listing")),
    "p6_found": lambda s, d: confusables.changed_fields(table(s, d, "listing")),
    "p6_ordinary": lambda s, d: confusables.unify(table(s, d, "listing")),
    "p6_neighborhood_groups": lambda s, d: confusables.groups(table(s, d, "listing"), "neighborhood"),
    "p6_title_groups": lambda s, d: confusables.groups(table(s, d, "listing"), "title"),
    "p7_found": lambda s, d: neardup.listing_pairs(table(s, d, "listing")),
    "p7_groups": lambda s, d: neardup.listing_groups(table(s, d, "listing")),
    "p8_ids": lambda s, d: bpe.encode(table(s, d, "documents")),
    "p8_counts": lambda s, d: bpe.count_tokens(table(s, d, "documents")),
    "p9_containers": lambda s, d: packing.containers(table(s, d, "documents")),
    "p9_summary": lambda s, d: packing.summary(packing.containers(table(s, d, "documents"))),
    "p10_found": lambda s, d: repetition.repeated(table(s, d, "documents")),
    "p10_profile": lambda s, d: repetition.profile(table(s, d, "documents")).select("doc_id", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in repetition.MEASURES], F.concat_ws(",", "broken_rules").alias("broken_rules")),
}

_PAIRS = {k: (str(PERSIAN_DIGITS.index(v)) if v in PERSIAN_DIGITS else v) for k, v in one_to_one().items()} | {d: str(i) for i, d in enumerate(PERSIAN_DIGITS)}
_PLAIN = "translate(text, '" + "".join(_PAIRS).replace("'", "''") + INVISIBLE + "', '" + "".join(_PAIRS.values()).replace("'", "''") + "')"
for _base, _mark, _whole in COMPOSED:
    _PLAIN = f"replace({_PLAIN}, '{_base}{_mark}', '{_whole}')"

_STOP = ", ".join(f"'{w}'" for w in repetition.STOP_WORDS)
_BROKEN = ", ".join(f"CASE WHEN {r.measure} {r.comparison} {r.bound} THEN '{r.name}' END" for r in repetition.RULES)
#: Words of five-word runs that stood earlier, by document.
_RUNS = """g AS (SELECT doc_id, len(w) AS n, i, array_to_string(w[i:i+4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) u(i)),
r AS (SELECT doc_id, n, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 5)) AS at FROM r WHERE k > 1)"""

_LETTER = r"[\x{620}-\x{64a}\x{671}-\x{6d3}]"
_JOINED = "t"
for _after in (rf"({_LETTER})", rf"({_LETTER})", r"(\s*|\.\.\.\s*|…\s*|�\s*)$"):
    _JOINED = rf"regexp_replace({_JOINED}, '({_LETTER})\x{{200c}}{_after}', '\1\2', 'g')"
_FIELDS = " UNION ALL ".join(f"SELECT listing_id, '{f}' AS field_name, {f} AS t FROM listing" for f in confusables.FIELDS)

ORACLE: dict[str, str] = {
    # texts that hold a character with another prototype, or a joiner that stands in no Persian word
    "p6_found": rf"""SELECT listing_id, field_name FROM ({_FIELDS}) WHERE regexp_matches({_JOINED}, '[^{PLAIN_CLASS.replace(chr(92) + "x{200c}", "")}]')""",
    "p10_found": rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower({_PLAIN}), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
{_RUNS} SELECT doc_id FROM c GROUP BY doc_id, n HAVING count(*) >= 0.3 * n""",
    "p10_profile": rf"""WITH w AS (SELECT doc_id, text AS t, regexp_extract_all(lower({_PLAIN}), '[\p{{L}}\p{{N}}]+') AS w, list_filter(string_split_regex(text, '\r?\n'), lambda x: trim(x) <> '') AS l FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
{_RUNS}, a AS (SELECT doc_id, count(*) AS again FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, length(t)::DOUBLE AS n_chars, len(w)::DOUBLE AS n_words, len(l)::DOUBLE AS n_lines, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END::DOUBLE AS mean_word_length,
 CASE WHEN len(w) > 0 THEN len(regexp_extract_all(t, '#|\.\.\.|…|[\p{{So}}\p{{Sk}}]')) / len(w) ELSE 0 END::DOUBLE AS symbol_share, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({_STOP}))) / len(w) ELSE 0 END::DOUBLE AS stop_word_share,
 CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣]'))) / len(l) ELSE 0 END::DOUBLE AS bullet_line_share, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) / len(l) ELSE 0 END::DOUBLE AS ellipsis_line_share,
 CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0 END::DOUBLE AS repeated_line_share, CASE WHEN len(w) > 0 THEN coalesce(again, 0) / len(w) ELSE 0 END::DOUBLE AS repeated_share FROM w LEFT JOIN a USING (doc_id))
SELECT doc_id, {", ".join(f"round({m}, 6) AS {m}" for m in repetition.MEASURES)}, concat_ws(',', {_BROKEN}) AS broken_rules FROM m""",
}
