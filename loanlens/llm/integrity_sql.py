"""DuckDB SQL of the queries on manifests, fingerprints and conversations."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row: the table of CRC-32 by byte.
_CRC = """crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text; the query reads ``crcs``."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"""


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


MERKLE = f"""
    WITH RECURSIVE {_CRC},
    leaves AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_leaf("text")} AS leaf,
        CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf("text")} END AS now
        FROM documents, crcs),
    placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    nodes AS (
        SELECT tree, 0 AS level, pos, leaf AS h, n FROM placed
        UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
    subroots AS (SELECT tree, level AS depth, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, pos, h, n FROM subroots
        UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
    runs AS (SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
    top_runs AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
    folds AS (
        SELECT rid, tree, 0 AS level, pos, now AS h, '' AS proof FROM placed
        UNION ALL SELECT rid, f.tree, f.level + 1, f.pos // 8,
            sha256(array_to_string(hs[:f.pos % 8] || [f.h] || hs[f.pos % 8 + 2:], '')), proof || array_to_string(hs[:f.pos % 8] || hs[f.pos % 8 + 2:], '')
        FROM folds f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 8),
    top_folds AS (
        SELECT rid, 0 AS level, s.pos, f.h, proof FROM folds f JOIN subroots s ON s.tree = f.tree AND s.depth = f.level
        UNION ALL SELECT rid, f.level + 1, f.pos // 8,
            sha256(array_to_string(hs[:f.pos % 8] || [f.h] || hs[f.pos % 8 + 2:], '')), proof || array_to_string(hs[:f.pos % 8] || hs[f.pos % 8 + 2:], '')
        FROM top_folds f JOIN top_runs r ON r.level = f.level AND r.run = f.pos // 8),
    root AS (SELECT level AS depth, h FROM tops WHERE n = 1)
    SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, t.h AS folded_root, t.h = root.h AS verified
    FROM placed p JOIN subroots s USING (tree) JOIN top_folds t USING (rid) JOIN root ON t.level = root.depth"""


def _repair() -> str:
    space = r"[\x20\x09-\x0D]"

    def edit(letter: str, cost: str, to: str, turn: str = "") -> str:
        lines = f"list_prepend({turn}, {to}.t)" if turn else f"{to}.t"
        return f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 't': {lines}}}"

    never = "{'c': 1000000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    turn = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def read(s: int) -> str:
        """Best way on from state ``s`` that does not insert first."""
        kept = " ".join(f"WHEN first = '{i}' THEN {edit('K', 'unended', f'n{to}', 'whole')}" for (q, i), to in keep.items() if q == s)
        named = edit("R", "2 + unended", f"n{after[s]}", f"'{turn[s]}:' || text")
        return f"list_min([{edit('D', '3', f'n{s}')}, CASE WHEN gone THEN {never} ELSE {named} END, CASE WHEN gone THEN {never} {kept} ELSE {never} END])"

    def insert(s: int, to: str) -> str:
        return edit("I", "2", to, f"'{turn[s]}:'")

    end = {0: "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}", 1: "{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}", 2: "{'c': 2::BIGINT, 'a': 'I', 't': ['assistant:']}"}
    end[3] = end[0]
    return f"""
    WITH RECURSIVE {_CRC},
    hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations, crcs),
    damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
    faults AS (SELECT *, left(role, 1) AS first, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following, role || ':' || text AS whole,
        CASE WHEN regexp_full_match(text, '{space}*') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?]{space}*\\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
    turns AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS unended FROM faults),
    counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (first || following NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
    ways AS (
        SELECT conv_id, n + 1 AS i, {end[0]} AS n0, {end[1]} AS n1, {end[2]} AS n2, {end[3]} AS n3 FROM counts
        UNION ALL
        SELECT conv_id, i, list_min([b0, {insert(0, "v2")}]), list_min([b1, {insert(1, "v2")}]), v2, v3 FROM (
            SELECT *, list_min([b2, {insert(2, "b3")}]) AS v2, list_min([b3, {insert(3, "b2")}]) AS v3 FROM (
                SELECT t.conv_id, t.i, {", ".join(f"{read(s)} AS b{s}" for s in range(4))}
                FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i - 1)))
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, coalesce(n0.c, 0) AS cost, coalesce(n0.a, '') AS audit, sha256(coalesce(array_to_string(n0.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.i = 1"""


REPAIR = _repair()
