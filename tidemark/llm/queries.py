"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op2_bpe
from tidemark.llm.decontaminate import op7_benchmark_decontamination
from tidemark.llm.html_extract import op4_html_extraction
from tidemark.llm.license_scan import op3_license_scan
from tidemark.llm.merkle import op13_merkle_manifest
from tidemark.llm.quality_classifier import op8_quality_classifier
from tidemark.llm.quality_rules import op1_quality_rules
from tidemark.llm.repeats import op12_substring_dedup
from tidemark.llm.resampling import op11_importance_resampling
from tidemark.llm.secret_scan import op6_secret_scan
from tidemark.llm.simhash import op5_simhash_near_dedup
from tidemark.llm.token_counts import op10_token_counts
from tidemark.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bpe": op2_bpe,
        "op3_license_scan": op3_license_scan,
        "op4_html_extraction": op4_html_extraction,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_warc": op9_warc,
        "op10_token_counts": op10_token_counts,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RULES_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS g FROM p),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(5)) AS o) GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(l) AS n_lines, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_capitals > n_letters OR 10 * n_letters < 6 * word_chars) AS kept FROM b
"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
q AS (SELECT item_id, coalesce({WORDS}, []) AS w FROM benchmark),
n AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS n FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM q WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM n),
p AS (SELECT doc_id, z.n, w, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, z WHERE len(w) >= z.n),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN n ON n.n = p.n AND n.g = array_to_string(w[i:i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text, bit by bit; -1 stands for a shift."""
    byte = f"16 * (instr('0123456789ABCDEF', substr(hex({text}), 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex({text}), 2 * i, 1)) - 1"
    steps = f"list_concat([4294967295], flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"


RESAMPLING_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce({WORDS}, []) AS w FROM documents),
q AS (SELECT coalesce({WORDS}, []) AS w FROM benchmark),
f AS (SELECT k, unnest(w) AS x FROM d),
g AS (SELECT unnest(w) AS x FROM q),
v AS (SELECT x, {crc32_sql("x")} % 10000 AS b FROM (SELECT x FROM f UNION SELECT x FROM g)),
s AS (SELECT b, count(*) AS n FROM f JOIN v USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN v USING (x) GROUP BY b),
m AS (SELECT (SELECT coalesce(sum(n), 0) + 10000 FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) + 10000 FROM t)::DOUBLE AS t),
e AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * m.s / ((coalesce(s.n, 0) + 1)::DOUBLE * m.t)))::BIGINT AS gain FROM (SELECT DISTINCT b FROM v) LEFT JOIN s USING (b) LEFT JOIN t USING (b), m),
w AS (SELECT k, sum(gain)::BIGINT AS total, count(*) AS n FROM f JOIN v USING (x) JOIN e USING (b) GROUP BY k),
h AS (SELECT doc_id, k, len(w) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, list_reduce(list_concat([0], list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 1)) - 1)), lambda a, c: 16 * a + c) AS h FROM d LEFT JOIN w USING (k)),
z AS (SELECT doc_id, k, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (k)
"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT k, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
g AS (SELECT k, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g FROM p),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, list(DISTINCT i + o) AS gone FROM r, (SELECT unnest(range(35)) AS o) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN c USING (k)
"""


def manifest_sql(levels: int = 8, crown: int = 4) -> str:
    """Trees of at most 8 ** levels leaves, and at most 8 ** crown of them."""

    def of(text: str) -> str:
        fields = " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END" for x in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({fields})"

    def climb(name: str, key: str, steps: int) -> str:
        out = ""
        for i in range(steps):
            side = f"string_agg(h, '') OVER (PARTITION BY {key}, r // 8 ORDER BY r ROWS BETWEEN"
            out += f"""
{name}s{i} AS (SELECT {key}, r, n, coalesce({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{i}),
{name}{i + 1} AS (SELECT {key}, r // 8 AS r, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h FROM {name}{i} GROUP BY {key}, r // 8),"""
        return out

    def fold(name: str, made: str, place: str, steps: int) -> str:
        out = ""
        for i in range(steps):
            out += f"""
{made}{i + 1} AS (SELECT x.k, CASE WHEN s.n > 1 THEN sha256(s.before || x.f || s.after) ELSE x.f END AS f, x.proof || s.before || s.after AS proof, x.tree, x.{place} // 8 AS {place}{", x.pos" if place != "pos" else ""} FROM {made}{i} x JOIN {name}s{i} s ON {"s.tree = x.tree AND " if place != "pos" else ""}s.r = x.{place}),"""
        return out

    return f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS k, {of("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {of("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM d),
n0 AS (SELECT tree, r, n, leaf AS h FROM o),{climb("n", "tree", levels)}
c0 AS (SELECT 0 AS one, tree AS r, count(*) OVER () AS n, h FROM n{levels}),{climb("c", "one", crown)}
f0 AS (SELECT k, coalesce(changed, leaf) AS f, '' AS proof, tree, r, tree AS pos FROM o),{fold("n", "f", "r", levels)}
e0 AS (SELECT k, f, proof, tree, pos FROM f{levels}),{fold("c", "e", "pos", crown)}
z AS (SELECT h AS root FROM c{crown})
SELECT doc_id, leaf, n{levels}.h AS subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM o JOIN e{crown} USING (k) JOIN n{levels} ON n{levels}.tree = o.tree, z
"""


def oracle_sql() -> dict[str, str]:
    """The others have tokens, fingerprints, models, matches' places or archives, which SQL does not express; brute force tests them."""
    return {"op1_quality_rules": RULES_SQL, "op7_benchmark_decontamination": DECONTAMINATION_SQL, "op11_importance_resampling": RESAMPLING_SQL, "op12_substring_dedup": REPEATS_SQL, "op13_merkle_manifest": manifest_sql()}
