"""The text operators that SQL can express, for an engine of its own. Nothing here is shared with the DataFrame code."""

from __future__ import annotations


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Exhaustive assignment and averaging, round by round."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024*x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)",
        f"cuts AS MATERIALIZED (SELECT vec_id, p, v[p*(len(v)//{parts})+1:(p+1)*(len(v)//{parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS p) q)",
        "part AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM cuts)",
        f"book0 AS MATERIALIZED (SELECT p, e, x, xx FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id)-1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) f USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, min({{'d': t.xx-2*list_inner_product(t.x, b.x)+b.xx, 'e': b.e}}) AS m FROM part t JOIN book{k} b USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            steps.append(f"sums{k} AS (SELECT p, e, place, floor(sum(c)/count(*)) AS c FROM (SELECT p, m.e AS e, unnest(range(len(x))) AS place, unnest(x) AS c FROM near{k} JOIN part USING (vec_id, p)) u GROUP BY p, e, place)")
            steps.append(f"mean{k} AS (SELECT p, e, list(c ORDER BY place) AS x FROM sums{k} GROUP BY p, e)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x, list_inner_product(coalesce(n.x, b.x), coalesce(n.x, b.x)) AS xx FROM book{k} b LEFT JOIN mean{k} n USING (p, e))")
    steps += [
        f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label)",
        "labels_ AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY label)",
        f"digest AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, place)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(len(x))) AS place, unnest(x) AS c FROM book{rounds}) u)",
    ]
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN labels_ ON labels_.label IS NOT DISTINCT FROM coded.label, digest"


def _crc32(text: str) -> str:
    """The CRC-32 of a text of ASCII letters: eight steps for each letter."""
    eight = "list_reduce([xor(c, b),0,0,0,0,0,0,0,0]::BIGINT[], lambda r, i: CASE WHEN r&1=1 THEN xor(r>>1, 3988292384) ELSE r>>1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {eight}), 4294967295::BIGINT)"


def _conversations() -> str:
    """Row by row, the lightest (cost, audit) of each role that may stand last."""

    def add(x: str, cost: str, letter: str) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c+{cost}, 'a': {x}.a||'{letter}'}} END"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    def keep(x: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND ini='{initial}' AND {x} IS NOT NULL THEN {{'c': {x}.c+cut, 'a': {x}.a||'K'}} END"

    def rerole(x: str) -> str:
        return f"CASE WHEN NOT gone AND {x} IS NOT NULL THEN {{'c': {x}.c+3+cut, 'a': {x}.a||'R'}} END"

    before_user = ("n", "s", "a")
    step = ", ".join([
        f"{add('n', '4', 'D')} AS n", f"{least(add('s', '4', 'D'), keep('n', 's'))} AS s",
        f"{least(add('u', '4', 'D'), *map(rerole, before_user), *(keep(x, 'u') for x in before_user))} AS u", f"{least(add('a', '4', 'D'), rerole('u'), keep('u', 'a'))} AS a",
    ])
    users = f"SELECT conv_id, place, n, s, a, {least('u', *(add(x, '3', 'I') for x in before_user))} AS u"
    closed = f"SELECT conv_id, place, n, s, u, {least('a', add('u', '3', 'I'))} AS a"
    nothing = "NULL::STRUCT(c BIGINT, a VARCHAR)"
    white = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, coalesce(conv_id::VARCHAR,' ')||':'||coalesce(turn::VARCHAR,' ') AS k FROM conversations),
    faulty AS (SELECT *, ({_crc32('k')})%20 AS f FROM src),
    damaged AS (SELECT conv_id, turn, CASE WHEN f=4 THEN 'user' ELSE role END AS role, CASE WHEN f=1 THEN '' WHEN f=2 THEN translate(text,'.!?','') ELSE text END AS text, unnest(range(CASE WHEN f=3 THEN 2 ELSE 1 END)) AS copy FROM faulty WHERE f<>0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, rtrim(text, {white}) AS bare FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place)>1 AS again FROM placed),
    marked AS MATERIALIZED (SELECT conv_id, turn, place, role, text, left(role,1) AS ini, bare='' AS blank, bare<>'' AND again AS dup, bare<>'' AND NOT again AND right(bare,1) NOT IN ('.','!','?') AS trunc,
        bare='' OR again AS gone, CASE WHEN right(bare,1) IN ('.','!','?') THEN 0 ELSE 3 END AS cut, lag(left(role,1)) OVER (PARTITION BY conv_id ORDER BY place) AS prev FROM seen),
    convs AS (SELECT DISTINCT conv_id FROM conversations),
    dp AS ({closed} FROM ({users} FROM (SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': ''}} AS n, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM convs) x) y
      UNION ALL {closed} FROM ({users} FROM (SELECT d.conv_id, m.place, {step} FROM dp d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.place=d.place+1) x) y),
    ends AS (SELECT conv_id, arg_max({least('n', 'a')}, place) AS w FROM dp GROUP BY conv_id),
    letters AS (SELECT conv_id, p, substr(w.a, p, 1) AS l, w.a AS audit FROM ends, unnest(range(1, len(w.a)+1)) t(p)),
    counted AS (SELECT *, sum((l<>'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY p) AS place, sum((l<>'D')::INTEGER) OVER (PARTITION BY conv_id ORDER BY p) AS j FROM letters),
    rows_ AS (SELECT c.conv_id, c.p, c.l, c.j, m.role, m.text FROM counted c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.place=c.place WHERE c.l<>'D'),
    led AS (SELECT conv_id, max((j=1 AND l='K' AND left(role,1)='s')::INTEGER) AS led FROM rows_ GROUP BY conv_id),
    told AS (SELECT r.conv_id, string_agg((CASE WHEN l='K' THEN role WHEN (j+led)%2=1 THEN 'user' ELSE 'assistant' END)||':'||(CASE WHEN l='I' THEN '' ELSE text END), chr(10) ORDER BY p) AS t FROM rows_ r JOIN led ON led.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY r.conv_id),
    sums AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(trunc) AS truncated, count_if(prev IS NOT NULL AND prev||ini NOT IN ('su','ua','au')) AS illegal FROM marked GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps,0)::BIGINT AS gaps, coalesce(blank,0)::BIGINT AS blank, coalesce(duplicate,0)::BIGINT AS duplicate, coalesce(truncated,0)::BIGINT AS truncated, coalesce(illegal,0)::BIGINT AS illegal, e.w.c AS cost, e.w.a AS audit, sha256(coalesce(t,'')) AS repaired_sha256
    FROM convs c JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _vector_codes(), "op12_repaired_conversations": _conversations()}
