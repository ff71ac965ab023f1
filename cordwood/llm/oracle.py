"""SQL for the queries that SQL can express, over the same tables, without the operators' filters."""

ORACLE_SQL = {
    # Every window of an item's size that begins at a shared shingle or ends the text, compared
    # exactly; no fingerprints.
    "op1_decontaminate": r"""
WITH doc_words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w
    FROM (SELECT DISTINCT doc_id, text FROM documents)
), doc_grams AS (
    SELECT doc_id, len(w) - 4 AS size, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS gram,
           unnest(range(0, len(w) - 4)) AS at
    FROM doc_words WHERE len(w) >= 5
), item_words AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS w
    FROM benchmark
), item_grams AS (
    SELECT item_id, gram, count(*) AS n_item FROM (
        SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS gram
        FROM item_words WHERE len(w) >= 5) GROUP BY item_id, gram
), item_size AS (
    SELECT item_id, sum(n_item) AS weight FROM item_grams GROUP BY item_id
), windows AS (
    SELECT DISTINCT d.doc_id, g.item_id, s.weight, least(d.size, s.weight) AS span,
           least(d.at, d.size - least(d.size, s.weight)) AS start
    FROM doc_grams d JOIN item_grams g USING (gram) JOIN item_size s USING (item_id)
), counted AS (
    SELECT w.doc_id, w.item_id, w.start, w.weight, w.span, d.gram, count(*) AS n
    FROM windows w JOIN doc_grams d ON d.doc_id = w.doc_id AND d.at >= w.start AND d.at < w.start + w.span
    GROUP BY ALL
), compared AS (
    SELECT c.doc_id, c.item_id, c.start, sum(least(c.n, g.n_item)) AS overlap, any_value(c.weight + c.span) AS total
    FROM counted c JOIN item_grams g ON g.item_id = c.item_id AND g.gram = c.gram
    GROUP BY c.doc_id, c.item_id, c.start
), rated AS (
    SELECT doc_id, item_id, start, CAST(overlap AS DOUBLE) / CAST(total - overlap AS DOUBLE) AS similarity
    FROM compared WHERE overlap * 100 >= (total - overlap) * 80
)
SELECT doc_id, item_id, max(similarity) AS similarity,
       CAST(min(start) FILTER (WHERE similarity = best) AS INTEGER) AS start_word
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS best FROM rated)
GROUP BY doc_id, item_id
""",
    # The cheapest edits row by row from the front: the least (cost, audit) for each state. States are
    # 0 nothing said, 1 after the system, 2 after a user, 3 after an assistant. The checksum is
    # worked out bit by bit.
    "op12_repair": r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
), summed AS (
    SELECT *, xor(4294967295::BIGINT, list_reduce(
        list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT),
        lambda c, b: list_reduce(range(8), lambda s, i: xor(s >> 1, (s & 1) * 3988292384), xor(c, b)),
        4294967295::BIGINT)) % 20 AS fate
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM summed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place
    FROM damaged
), judged AS (
    SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'sound' END AS fault
    FROM placed
), neighbours AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS previous FROM judged
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE previous IS NOT NULL AND (previous, initial) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal,
           count(*) AS size
    FROM neighbours GROUP BY conv_id
), inserts(before, behind, letters, said) AS (
    VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
           (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
           (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])
), edits(letter, initial, before, behind, paid) AS (
    SELECT 'D', -1, s, s, 4 FROM range(4) r(s)
    UNION ALL VALUES ('K', 1, 0, 1, 0), ('K', 2, 0, 2, 0), ('K', 2, 1, 2, 0), ('K', 2, 3, 2, 0), ('K', 3, 2, 3, 0),
                     ('R', -1, 0, 2, 3), ('R', -1, 1, 2, 3), ('R', -1, 2, 3, 3), ('R', -1, 3, 2, 3)
), paths AS (
    SELECT conv_id, 0::BIGINT AS place, 0::BIGINT AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM counted
    UNION ALL
    SELECT p.conv_id, j.place, e.behind::BIGINT,
           p.cost + 3 * length(i.letters) + e.paid + CASE WHEN e.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END AS total,
           p.audit || i.letters || e.letter AS written,
           list_concat(p.said, i.said, CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [j.role || ':' || j.text]
               ELSE [(CASE e.behind WHEN 2 THEN 'user' ELSE 'assistant' END) || ':' || j.text] END)
    FROM paths p
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.place = p.place + 1
    JOIN inserts i ON i.before = p.state
    JOIN edits e ON e.before = i.behind AND e.initial IN (-1, j.initial)
        AND (e.letter = 'D' OR j.fault IN ('sound', 'truncated'))
    QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.behind ORDER BY total, written) = 1
), finished AS (
    SELECT p.conv_id, p.cost + 3 * length(i.letters) AS cost, p.audit || i.letters AS audit, list_concat(p.said, i.said) AS said
    FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.size = p.place
    JOIN inserts i ON i.before = p.state AND i.behind IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 3 * length(i.letters), p.audit || i.letters) = 1
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(f.cost, 0) AS cost,
       coalesce(f.audit, '') AS audit, sha256(coalesce(array_to_string(f.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN finished f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    # Every term of every pair of sources by itself, without cells.
    "op13_divergence": r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
    FROM documents
), said AS (
    SELECT row, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), terms AS (
    SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), langs AS (
    SELECT lang, sum(total)::HUGEINT AS n_lang, count(*)::HUGEINT AS v FROM terms GROUP BY lang
), counts AS (
    SELECT s.lang, s.source, s.term, count(*) AS n FROM said s JOIN terms t USING (lang, term) GROUP BY ALL
), sources AS (
    SELECT d.lang, d.source, coalesce(sum(c.n), 0)::HUGEINT AS n_group
    FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n_group + l.v) AS p,
           1 + (1000000000::HUGEINT * (t.total + 1)) // (l.n_lang + l.v) AS q
    FROM sources s JOIN langs l USING (lang) JOIN terms t USING (lang)
    LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term
), distances AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM sources a JOIN sources b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), leading_terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM leading_terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
