"""DuckDB SQL of the corpus queries that SQL can express.

Merkle proofs are climbed level by level over positions, a trie's nodes are
the texts of their paths and subtrees are joined over all ancestors, and chat
digests come straight from the source.  Licences go another way than the operator: sentences become rows, known ones
are found by a join, and a licence is read from whether any of its rules held.
Lines are handled one by one there.  WARC digests are spelled from SHA-1's hexadecimal digits.
"""

from __future__ import annotations

from . import license_rules as L


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_scans() -> str:
    known = ",\n".join(f"({_text(L.normal(s))}, {_text(key)})" for key, many in L.SENTENCES.items() for s in many)
    steps, tests, cases = [], {}, []
    for k, (name, keys) in enumerate(L.RULES):
        wanted = _text("|" + "|".join(keys) + "|")
        # twice: neighbouring matches share a bar
        steps.append(f"replace(replace(r{k}, {wanted}, '||'), {wanted}, '||') AS r{k + 1}")
        # the first of a licence's rules that held gives its place
        held, before = f"contains(r{k}, {wanted})", tests.setdefault(name, [])
        cases.append(f"CASE WHEN {' AND '.join([held, *(f'NOT {x}' for x in before)])} THEN {_text(name)} END")
        before.append(held)
    licences = ",\n".join(cases)
    return rf"""
WITH known(sentence, id) AS (VALUES
{known}),
numbered AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
bare AS (SELECT row_no, list_transform(lines, lambda x: regexp_replace(x, '^{L.COMMENT}($|[ \t\r])', '\1')) AS lines FROM numbered),
ended AS (
    SELECT row_no, list_transform(lines, lambda x: regexp_replace(
               CASE WHEN regexp_full_match(x, '[ \t\r]*') THEN 'X' ELSE regexp_replace(x, '^{L.ITEM}', 'X') END,
               '[.!?;]+([ \t\rX]|$)', 'X', 'g')) AS lines FROM bare),
plain AS (SELECT row_no, regexp_replace('X' || array_to_string(lines, 'N') || 'X', '[^a-z0-9XN]+', ' ', 'g') AS line FROM ended),
joined AS (SELECT row_no, regexp_replace(regexp_replace(line, '[ N]*X[ XN]*', 'X', 'g'), ' ?N[ N]*', 'N', 'g') AS line FROM plain),
parts AS (
    SELECT row_no, greatest(length(regexp_replace(line, '[^X]', '', 'g')) - 1, 0) AS n_sentences,
           -- both sides of a line get a mark of their own
           regexp_extract_all(replace(replace(line, 'N', 'NN'), 'X', 'XX'), '[XN]({L.sentence_pattern(L.SENTENCES, "(?: |NN)")})[XN]', 1) AS cut
    FROM joined),
placed AS (SELECT row_no, replace(unnest(cut), 'NN', ' ') AS sentence, generate_subscripts(cut, 1) AS place FROM parts),
told AS (SELECT row_no, string_agg(coalesce(id, '?'), '|' ORDER BY place) AS ids, string_agg(id, ',' ORDER BY place) AS known_ids
         FROM placed LEFT JOIN known USING (sentence) GROUP BY row_no),
used AS (SELECT row_no, known_ids, regexp_replace('|' || coalesce(ids, '') || '|', '\?[?|]*', '?|', 'g') AS r0,
{", ".join(steps)}
         FROM told)
SELECT doc_id, n_sentences::BIGINT AS n_sentences, coalesce(known_ids, '') AS sentence_ids,
       concat_ws(',', {licences}) AS licences,
       coalesce(trim(regexp_replace(r{len(L.RULES)}, '[?|]+', ',', 'g'), ','), '') AS unmatched
FROM numbered JOIN parts USING (row_no) LEFT JOIN used USING (row_no)
"""


def warc() -> str:
    # twenty bits are five hexadecimal digits and four letters of base 32
    bits = "('0x' || substr(sha1(payload), 5 * g + 1, 5))::BIGINT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({bits}) >> {k}) & 31)::INT + 1, 1)" for k in (15, 10, 5, 0))
    return f"""
WITH kept AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM kept GROUP BY payload)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: {letters}), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM kept JOIN firsts USING (payload)
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda crc, byte: {bits}, 4294967295::BIGINT), 4294967295)"


def merkle() -> str:
    fields = [f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: f"sha256({' || '.join(fields)} || coalesce(octet_length(encode({text})) || ':' || {text}, '-'))"
    return f"""
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS row_no, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           {leaf("text")} AS leaf,
           CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS start
    FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY tree) AS n FROM hashed),
low AS (
    SELECT tree, 0 AS level, pos, leaf AS hash, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3
    FROM low WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree, hash FROM low WHERE n = 1),
top AS (
    SELECT -1 AS tree, 0 AS level, tree AS pos, hash, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3
    FROM top WHERE n > 1 GROUP BY tree, level, pos // 3, n),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM top),
runs AS (SELECT tree, level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM nodes WHERE n > 1 GROUP BY ALL),
steps AS (
    SELECT tree, level, pos, array_to_string(hashes[:pos % 3], '') AS lft, array_to_string(hashes[pos % 3 + 2:], '') AS rgt,
           tree AS up_tree, level + 1 AS up_level, pos // 3 AS up_pos, true AS folds
    FROM nodes JOIN runs USING (tree, level) WHERE n > 1 AND run = pos // 3
    UNION ALL
    SELECT tree, level, pos, '', '', -1, 0, tree, false FROM low WHERE n = 1),
climb AS (
    SELECT row_no, tree, 0 AS level, pos, start AS folded, '' AS proof FROM leaves
    UNION ALL
    SELECT row_no, up_tree, up_level, up_pos, CASE WHEN folds THEN sha256(lft || folded || rgt) ELSE folded END, proof || lft || rgt
    FROM climb JOIN steps USING (tree, level, pos))
SELECT l.doc_id, l.leaf, s.hash AS subroot, t.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = t.hash AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN top t ON t.n = 1 JOIN climb c ON c.row_no = l.row_no AND c.tree = -1 AND c.level = t.level
"""


def prefix_trie() -> str:
    return f"""
WITH said AS (
    SELECT conv_id AS conv, sha256(coalesce(octet_length(encode(role)), 0) || ':' || coalesce(role, '') || coalesce(text, '')) AS hash,
           octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, hash) - 1 AS place FROM said),
convs AS (SELECT conv, conv - conv % 5 AS base, {crc32("conv::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv FROM said)),
steps AS (
    SELECT c.conv, 0 AS own, p.place, p.hash, p.bytes FROM convs c JOIN placed p ON p.conv = c.base AND p.place < c.h
    UNION ALL
    SELECT c.conv, 1, p.place, p.hash, p.bytes FROM convs c JOIN placed p ON p.conv = c.conv AND p.place >= c.h),
paths AS (
    SELECT conv, row_number() OVER w AS depth, string_agg(hash, '') OVER w AS path, bytes,
           count(*) OVER (PARTITION BY conv) AS steps
    FROM steps WINDOW w AS (PARTITION BY conv ORDER BY own, place)
    UNION ALL
    SELECT conv, 0, '', 0, (SELECT count(*) FROM steps s WHERE s.conv = c.conv) FROM convs c),
nodes AS (
    SELECT path, any_value(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS save,
           sha256(coalesce(string_agg(conv, ',' ORDER BY conv) FILTER (depth = steps), '')) AS ends_sha256
    FROM paths GROUP BY path),
children AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
linked AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
above AS (SELECT left(path, 64 * unnest(range(depth + 1))) AS path, n_children, save FROM linked),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(save)::BIGINT AS saved_tokens FROM above GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM linked n JOIN sums s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
"""


def chat() -> str:
    def longer(text: str, controls: str) -> str:
        return f"length(regexp_replace({text}, '(\\\\*)({controls})', '\\\\\\1\\2', 'g'))"
    return rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
told AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role) AS said,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '') AS loss,
           sum(15 + {longer("role", "### |</turn>|" + chr(10))} + {longer("text", "### |</turn>")})::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM told
"""


ORACLES = {"op2_license_scans": license_scans(), "op10_warc": warc(), "op11_merkle_manifest": merkle(), "op12_prefix_trie": prefix_trie(),
           "op13_chat_formatting": chat()}
