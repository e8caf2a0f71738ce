"""DuckDB SQL of the queries, by name. Only fixed values (stop words, phrases) come from the engine."""

from __future__ import annotations

import re

from .functions.text import ABSTENTION_PHRASES, STOP_WORDS

_HASH = "('0x' || substr(md5({}), 1, 8))::bigint"


def _hash(*parts: str) -> str:
    return _HASH.format("concat_ws('|', " + ", ".join(parts) + ")")


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))) + "]"


_BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_./+-]+')"


def _content(x: str) -> str:
    return f"list_filter(list_transform({_tokens(x)}, lambda t: trim(t, './-+_')), lambda t: length(t) > 1 and not list_contains({_STOP}, t))"


def _sentences(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(coalesce({x}, ''), '([.!?])\s+', concat('\1', chr(10)), 'g'), '\n+'), lambda s: trim(regexp_replace(s, '\s', ' ', 'g')) <> '')"


def _syllables(w: str) -> str:
    b = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    n = f"len(regexp_extract_all({b}, '[aeiouy]+'))"
    return f"(case when {b} = '' then 0 else greatest(1, {n} - case when {b} like '%e' and {n} > 1 then 1 else 0 end) end)"


def _abstains(x: str) -> str:
    a = f"lower(trim(coalesce({x}, ''), {_BLANK}))"
    said = " or ".join([f"contains(substr({a}, 1, 61), 'insufficient evidence')", *[f"contains(substr({a}, 1, 90), '{p}')" for p in ABSTENTION_PHRASES]])
    return f"({a} = '' or {said})"


def _windows(source: str, size: int, stride: int) -> str:
    return f"""select doc_id, k as chunk_no, list_sum(len[1:lead + {2 * stride} * k])::bigint as s0,
        list_sum(len[1:lead + 2 * least(k * {stride} + {size}, n) - 1])::bigint as char_end, least(k * {stride} + {size}, n) - k * {stride} as n_words
        from (select doc_id, len, lead, n, unnest(range(0, case when n <= {size} then 1 else ceil((n - {size}) / {stride}.0)::bigint + 1 end)) as k
              from (select doc_id, len, lead, (len(len) - lead + 1) // 2 as n
                    from (select doc_id, list_transform(regexp_extract_all(text, '\\S+|\\s+'), lambda p: length(p)) as len, regexp_matches(text, '^\\s')::int as lead from {source})) where n > 0)"""


def _chunks(source: str, size: int, stride: int) -> str:
    return f"(select doc_id, chunk_no, coalesce(s0, 0) as char_start, char_end, n_words from ({_windows(source, size, stride)}))"


def _word_rows(source: str) -> str:
    """Words with their characters, the strength of the break before them, and their line."""
    return f"""(select doc_id, row_number() over (partition by doc_id order by i) - 1 as wn, (e - length(part))::bigint as s, e::bigint as e, line,
        case when regexp_matches(gap, '\\n[ \\t]*\\n') then 3 when contains(gap, chr(10)) then 2 when before <> '' and contains('.!?;:', right(before, 1)) then 1 else 0 end as st
        from (select doc_id, i, part, sum(length(part)) over w as e, coalesce(lag(part) over w, '') as gap, coalesce(lag(part, 2) over w, '') as before, coalesce(sum(length(part) - length(replace(part, chr(10), ''))) over (w rows between unbounded preceding and 1 preceding), 0) as line
              from (select doc_id, unnest(p) as part, generate_subscripts(p, 1) as i from (select doc_id, regexp_extract_all(text, '\\S+|\\s+') as p from {source})) window w as (partition by doc_id order by i))
        where not regexp_matches(part, '^\\s'))"""


def _numbered(words: str, by: str, size: int) -> str:
    """Words with the number of their piece (k) within by."""
    return f"""(select *, sum(b_::int) over (partition by {by} order by wn) - 1 as k from (select *, f_ or case lv when 4 then false when 0 then run_ % {size} = 0 else st >= lv end as b_ from
        (select *, case when n_ <= {size} then 4 when c3 <= {size} then 3 when c2 <= {size} then 2 when c1 <= {size} then 1 else 0 end as lv from
         (select *, count(*) over (partition by {by}, s3) as c3, count(*) over (partition by {by}, s2) as c2, count(*) over (partition by {by}, s1) as c1, row_number() over (partition by {by}, s1 order by wn) - 1 as run_ from
          (select *, sum((f_ or st >= 3)::int) over w as s3, sum((f_ or st >= 2)::int) over w as s2, sum((f_ or st >= 1)::int) over w as s1 from
           (select *, count(*) over (partition by {by}) as n_, row_number() over (partition by {by} order by wn) = 1 as f_ from {words}) window w as (partition by {by} order by wn)))))) """


def _pieces(words: str, by: str, size: int) -> str:
    return f"(select {by}, k, count(*) as units, min(s) as s, max(e) as e from {_numbered(words, by, size)} group by {by}, k)"


def _packed(pieces: str, by: str, size: int, tail: int, forced: str = "false") -> str:
    """Chunks (by..., c, s, e) of pieces, by following from each chunk's end to the next."""
    same = lambda a, b: " and ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in by.split(","))
    return f"""(with recursive p_ as materialized (select * from {pieces}),
        t_ as (select {by}, k, units, s, e, coalesce(sum(units) over (partition by {by} order by k rows between unbounded preceding and 1 preceding), 0)::bigint as total, {forced} as stops from p_
               union all select {by}, max(k) + 1, null, null, null, sum(units)::bigint, true from p_ group by {by}),
        u_ as (select *, max(k) over (partition by {by} order by total range between current row and {size} following) as full_, min(k) over (partition by {by} order by total range between {tail} preceding and current row) as kept,
               min(k) over (partition by {by} order by total range between {size} preceding and current row) as room from t_),
        v_ as (select *, lead(room) over (partition by {by} order by k) as next_room, min(case when stops then k end) over (partition by {by} order by k rows between 1 following and unbounded following) as stop from u_),
        x_ as materialized (select *, case when stops or k = 0 then k else least(k, greatest(kept, next_room)) end as beg from v_),
        y_ as materialized (select {", ".join("x_." + c.strip() for c in by.split(","))}, x_.k, x_.beg, least(greatest(b.full_, x_.k + 1), x_.stop) as nxt from x_ join x_ b on {same("x_", "b")} and b.k = x_.beg where x_.stop is not null),
        z_ as (select {by}, 0 as c, beg, nxt from y_ where k = 0 union all select {", ".join("y_." + c.strip() for c in by.split(","))}, z_.c + 1, y_.beg, y_.nxt from z_ join y_ on {same("z_", "y_")} and y_.k = z_.nxt)
        select {", ".join("z_." + c.strip() for c in by.split(","))}, z_.c, a.s, b.e, q.total - a.total as units from z_ join x_ a on {same("z_", "a")} and a.k = z_.beg join x_ b on {same("z_", "b")} and b.k = z_.nxt - 1 join x_ q on {same("z_", "q")} and q.k = z_.nxt)"""


def _ordered(chunks: str, order: str = "c") -> str:
    return f"(select doc_id, row_number() over (partition by doc_id order by o_) - 1 as chunk_no, s as char_start, e as char_end from (select doc_id, s, e, min(({order})) as o_ from {chunks} group by all))"


def _plain_chunks(source: str, size: int, tail: int) -> str:
    return _ordered(_packed(_pieces(_word_rows(source), "doc_id", size), "doc_id", size, tail))


def _line_chunks(source: str, size: int, tail: int) -> str:
    """Lines as sections: one that is too long is cut on its own, and both it and the line behind it begin chunks."""
    words = f"(select *, count(*) over (partition by doc_id, line) > {size} as long from {_word_rows(source)})"
    free = f"(select doc_id, line, 0 as k, count(*) as units, min(s) as s, max(e) as e from {words} where not long group by doc_id, line)"
    cut = _packed(_pieces(f"(select * from {words} where long)", "doc_id, line", size), "doc_id, line", size, tail)
    every = f"""(with l_ as materialized (select distinct doc_id, line from {words} where long)
        select doc_id, row_number() over (partition by doc_id order by line, k) - 1 as k, units, s, e, forced from
        (select f.doc_id, f.line, k, units, s, e, l_.line is not null as forced from {free} f left join l_ on l_.doc_id = f.doc_id and l_.line = f.line - 1 union all select doc_id, line, c, units, s, e, true from {cut}))"""
    return _ordered(_packed(every, "doc_id", size, 0, "forced"))


def _semantic_chunks(source: str, size: int, tail: int) -> str:
    """Stretches between pieces of up to 64 words that are further apart than 95 % of their document's, each piece with its neighbours."""
    by = "doc_id, part"
    around = f"(select doc_id, k, substr(text, a + 1, b - a) as text from (select doc_id, k, coalesce(lag(s) over w, s) as a, coalesce(lead(e) over w, e) as b from many window w as (partition by doc_id order by k)) join {source} using (doc_id))"
    vectors = f"(select doc_id, k, dim, c / sqrt(sum(c * c) over (partition by doc_id, k)) as x from (select doc_id, k, {_hash('t')} % 64 as dim, count(*)::double as c from (select doc_id, k, unnest({_tokens('text')}) as t from {around}) group by all))"
    return f"""(with numbered as materialized (select * exclude (k), k as piece from {_numbered(_word_rows(source), 'doc_id', 64)}),
        rows_ as materialized (select *, count(*) over (partition by doc_id) as n from (select doc_id, piece as k, count(*) as units, min(s) as s, max(e) as e from numbered group by all)),
        many as materialized (select * from rows_ where n > 2), vec as materialized {vectors},
        apart as materialized (select m.doc_id, m.k, round(1 - coalesce(y, 0), 9) as apart from many m left join (select a.doc_id, b.k, sum(a.x * b.x) as y from vec a join vec b on b.doc_id = a.doc_id and b.k = a.k + 1 and b.dim = a.dim group by all) using (doc_id, k) where m.k > 0),
        opens as (select m.*, sum(coalesce(apart > lim, false)::int) over (partition by m.doc_id order by m.k) as g from many m left join apart using (doc_id, k) left join (select doc_id, round(quantile_cont(apart, 0.95), 9) as lim from apart group by 1) using (doc_id)),
        heads as (select *, row_number() over (partition by doc_id, g order by k) = 1 and (sum(units) over (partition by doc_id, g) >= 16 or g = 0) as head from opens),
        parts as (select doc_id, k as piece, sum(head::int) over (partition by doc_id order by k) as part from heads),
        held as materialized (select numbered.* exclude (n_, f_, s1, s2, s3, c1, c2, c3, run_, lv, b_), part, count(*) over (partition by doc_id, part) as held from numbered join parts using (doc_id, piece))
        select * from {_ordered(f"(select doc_id, 0 as part, c, s, e from {_packed('(select * from rows_ where n <= 2)', 'doc_id', size, tail)} union all select doc_id, part, 0, min(s), max(e) from held where held <= {size} group by all union all select doc_id, part, c, s, e from {_packed(_pieces(f'(select * exclude (held) from held where held > {size})', by, size), by, size, tail)})", "part, c")})"""


#: What the evaluation queries share, in order of use.
_BASE = {
    "asked": """select b.item_id as question_id, array_to_string(string_split(b.text, ' ')[1:12], ' ') as query, case when b.item_id % 2 = 0 then 'train' else 'dev' end as split,
        h.doc_id is not null as answerable, h.doc_id as gold_doc, (instr(h.text, b.text) - 1)::bigint as gold_start, (instr(h.text, b.text) - 1 + length(b.text))::bigint as gold_end
        from benchmark b left join (select b.item_id, min(d.doc_id) as doc_id from benchmark b join documents d on contains(d.text, b.text) group by 1) m on m.item_id = b.item_id
        left join documents h on h.doc_id = m.doc_id""",
    "ring": "select doc_id, row_number() over (order by md5(doc_id::varchar), doc_id) - 1 as place from documents",
    "cands": f"""select question_id, doc_id from (select question_id, doc_id, row_number() over (partition by question_id order by j) as nth from asked, range(0, 50) r(j), (select count(*) as n from documents), ring
        where j < n and place = ({_hash("question_id")} + j) % n and doc_id is distinct from gold_doc) where nth <= 49 union all select question_id, gold_doc from asked where gold_doc is not null""",
    "visible": "select doc_id, text from documents where doc_id in (select doc_id from cands)",
    "chunks": _chunks("visible", 64, 58),
    "texts": "select c.doc_id, chunk_no, substr(text, char_start + 1, char_end - char_start) as text from chunks c join visible v using (doc_id)",
    "pairs": "select question_id, c.doc_id, chunk_no from cands q join chunks c using (doc_id)",
    "post": f"select doc_id, chunk_no, term, count(*) as tf from (select doc_id, chunk_no, unnest({_tokens('text')}) as term from texts) group by all",
    "terms": f"select distinct question_id, unnest({_tokens('query')}) as term from asked",
    "weights": f"""select p.doc_id, p.chunk_no, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as w
        from post p join (select term, count(*) as df from post group by 1) using (term) join (select doc_id, chunk_no, len({_tokens('text')}) as dl from texts) using (doc_id, chunk_no),
        (select count(*) as n, greatest(1, avg(len({_tokens('text')}))) as avgdl from texts)""",
    "bm25": """select p.question_id, p.doc_id, p.chunk_no, round(coalesce(h.s, 0), 9) as score from pairs p left join
        (select question_id, p.doc_id, p.chunk_no, sum(w) as s from pairs p join terms using (question_id) join weights w on w.doc_id = p.doc_id and w.chunk_no = p.chunk_no and w.term = terms.term group by all) h using (question_id, doc_id, chunk_no)""",
    "qv": f"""select question_id, dim, c / sqrt(sum(c * c) over (partition by question_id)) as x from
        (select question_id, {_hash("t")} % 64 as dim, count(*)::double as c from (select question_id, unnest({_tokens('query')}) as t from asked) group by all)""",
    "cv": f"""select doc_id, chunk_no, dim, c / sqrt(sum(c * c) over (partition by doc_id, chunk_no)) as x from
        (select doc_id, chunk_no, {_hash("t")} % 64 as dim, count(*)::double as c from (select doc_id, chunk_no, unnest({_tokens('text')}) as t from texts) group by all)""",
    "dense": """select p.question_id, p.doc_id, p.chunk_no, round(coalesce(h.s, 0), 9) as score from pairs p left join
        (select p.question_id, p.doc_id, p.chunk_no, sum(q.x * c.x) as s from pairs p join qv q using (question_id) join cv c on c.doc_id = p.doc_id and c.chunk_no = p.chunk_no and c.dim = q.dim group by all) h using (question_id, doc_id, chunk_no)""",
    "r_bm25": "select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_no) as rnk from bm25",
    "r_dense": "select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_no) as rnk from dense",
    "r_rrf": """select * from (select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_no) as rnk from
        (select question_id, doc_id, chunk_no, round(sum(1.0::double / (60 + rnk)), 9) as score from (select * from r_bm25 where rnk <= 20 union all select * from r_dense where rnk <= 20) group by all)) where rnk <= 20""",
    "z_bm25": "select question_id, doc_id, chunk_no, round(case when stddev_pop(score) over w > 1e-12 then (score - avg(score) over w) / stddev_pop(score) over w else 0 end, 9) as score from bm25 window w as (partition by question_id)",
    "z_dense": "select question_id, doc_id, chunk_no, round(case when stddev_pop(score) over w > 1e-12 then (score - avg(score) over w) / stddev_pop(score) over w else 0 end, 9) as score from dense window w as (partition by question_id)",
    "r_weighted": """select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_no) as rnk from
        (select question_id, doc_id, chunk_no, round(0.5::double * d.score + 0.5::double * b.score, 9) as score from z_dense d join z_bm25 b using (question_id, doc_id, chunk_no))""",
    "r_reranked": f"""select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_no) as rnk from
        (select question_id, r.doc_id, r.chunk_no, round(case when len(q) > 0 then len(list_intersect(q, {_content('text')})) / len(q)::double else 0 end, 9) as score
         from r_dense r join (select question_id, list_distinct({_content('query')}) as q from asked) using (question_id) join texts t on t.doc_id = r.doc_id and t.chunk_no = r.chunk_no where rnk <= 20)""",
    "ranks": """select 'bm25' as configuration, * from r_bm25 union all select 'dense', * from r_dense union all select 'hybrid_rrf', * from r_rrf
        union all select 'hybrid_weighted', * from r_weighted union all select 'dense_reranked', * from r_reranked""",
    "top20": "select configuration, question_id, r.doc_id, chunk_no, rnk, char_start, char_end from ranks r join chunks using (doc_id, chunk_no) where rnk <= 20",
    "gold_rank": """select configuration, question_id, doc_id, row_number() over (partition by configuration, question_id order by f) as gold_rank from
        (select configuration, question_id, doc_id, min(rnk) as f from top20 group by all)""",
    "ctx": """select t.*, gold_start, gold_end, gold_doc, doc_id = gold_doc and char_end > gold_start and char_start < gold_end as hit from top20 t join asked using (question_id) where rnk <= 5 and answerable""",
    "cover": """select configuration, question_id, sum(greatest(0, b - greatest(a, coalesce(seen, a)))) / max(gold_end - gold_start) as coverage from
        (select *, max(b) over (partition by configuration, question_id order by a, b rows between unbounded preceding and 1 preceding) as seen from
         (select configuration, question_id, gold_start, gold_end, greatest(char_start, gold_start) as a, least(char_end, gold_end) as b from ctx where hit)) group by all""",
    "traces": """select c.configuration, a.question_id, a.split, g.gold_rank, g.gold_rank is not null as in_top_20, coalesce(x.in5, false) as in_top_5, coalesce(v.coverage, 0) as coverage, coalesce(x.prec, 0) as context_precision,
        coalesce(x.in5, false) and coalesce(v.coverage, 0) < 0.8 as boundary_loss, coalesce(1.0::double / g.gold_rank, 0) as mrr,
        (coalesce(g.gold_rank, 99) <= 5)::int::double as recall_5, (coalesce(g.gold_rank, 99) <= 10)::int::double as recall_10, (coalesce(g.gold_rank, 99) <= 20)::int::double as recall_20,
        case when g.gold_rank <= 5 then 0.2::double else 0 end as precision_5, case when g.gold_rank <= 10 then 0.1::double else 0 end as precision_10, case when g.gold_rank <= 20 then 0.05::double else 0 end as precision_20,
        case when g.gold_rank <= 5 then 1 / log2(g.gold_rank + 1) else 0 end as ndcg_5, case when g.gold_rank <= 10 then 1 / log2(g.gold_rank + 1) else 0 end as ndcg_10, case when g.gold_rank <= 20 then 1 / log2(g.gold_rank + 1) else 0 end as ndcg_20
        from asked a cross join (select unnest(['bm25', 'dense', 'hybrid_rrf', 'hybrid_weighted', 'dense_reranked']) as configuration) c
        left join gold_rank g on g.configuration = c.configuration and g.question_id = a.question_id and g.doc_id = a.gold_doc
        left join (select configuration, question_id, bool_or(doc_id = gold_doc) as in5, avg(hit::int) as prec from ctx group by all) x on x.configuration = c.configuration and x.question_id = a.question_id
        left join cover v on v.configuration = c.configuration and v.question_id = a.question_id where a.answerable""",
    "hits": """select question_id, a, b, row_number() over (partition by question_id order by a, b) as i from (select question_id, greatest(char_start, gold_start) as a, least(char_end, gold_end) as b
        from asked join chunks on doc_id = gold_doc and char_end > gold_start and char_start < gold_end)""",
    "d1": "select *, b - a as v from hits",
    "d2": "select x.question_id, x.a, x.b, x.i, greatest(any_value(x.b - x.a), max(p.v + x.b - greatest(x.a, p.b))) as v from hits x left join d1 p on p.question_id = x.question_id and p.i < x.i and p.b < x.b group by all",
    "d3": "select x.question_id, x.a, x.b, x.i, greatest(any_value(x.b - x.a), max(p.v + x.b - greatest(x.a, p.b))) as v from hits x left join d2 p on p.question_id = x.question_id and p.i < x.i and p.b < x.b group by all",
    "d4": "select x.question_id, x.a, x.b, x.i, greatest(any_value(x.b - x.a), max(p.v + x.b - greatest(x.a, p.b))) as v from hits x left join d3 p on p.question_id = x.question_id and p.i < x.i and p.b < x.b group by all",
    "d5": "select x.question_id, x.a, x.b, x.i, greatest(any_value(x.b - x.a), max(p.v + x.b - greatest(x.a, p.b))) as v from hits x left join d4 p on p.question_id = x.question_id and p.i < x.i and p.b < x.b group by all",
    "ceil": """select a.question_id, a.split, coalesce(max(v) / any_value(gold_end - gold_start)::double, 0) as ceiling, coalesce(max(b - d.a) / any_value(gold_end - gold_start)::double, 0) as best_single, count(d.i) as n_hits,
        (select count(*) from chunks c where c.doc_id = any_value(gold_doc)) as n_gold_chunks from asked a left join d5 d using (question_id) where a.answerable group by all""",
    "staged": """select t.*, c.ceiling, case when coalesce(c.ceiling, 1) < 0.8 then 'S1' when not in_top_20 then 'S2' when not (in_top_5 and coverage >= 0.8) then 'S3' else 'R' end as stage from traces t left join ceil c using (question_id)""",
    "recs": """select r.*, case when conv_id % 3 <> 0 then g end as gold from (select conv_id, turn, case when conv_id % 2 = 0 then 'train' else 'dev' end as split, text as question, answer, context from
        (select *, lead(role) over w as nr, lead(text) over w as answer, array_to_string(list(text) over (partition by conv_id order by turn rows unbounded preceding), ' ') as context from conversations window w as (partition by conv_id order by turn))
        where role = 'user' and nr = 'assistant') r join (select conv_id, arg_max(text, turn) as g from conversations where role = 'assistant' group by 1) using (conv_id)""",
    "cited": """select conv_id, turn, concat(text, case (conv_id + turn) % 5 when 0 then '' when 1 then concat(' [swg', conv_id, '::chunk_1]') when 2 then concat(' [swg', conv_id, '::chunk_1] and [nas2::chunk_3]')
        when 3 then ' [a1::chunk_1] [b2::chunk_2] [c3::chunk_3]' else concat(chr(10), 'Evidence: [nas2::chunk_3] [swg', conv_id) end) as answer from conversations where role = 'assistant'""",
    "lev": "select user_id as id, event_type as level, round(avg(value), 9) as x from events group by all",
    "lab": f"""select doc_id, quality as y, round(0.6::double * least(1, n_chars / 4000.0::double) + 0.4::double * ({_hash("doc_id")} % 1000 / 1000.0::double), 9) as score, case when doc_id % 2 = 0 then 'train' else 'dev' end as split
        from labels join documents using (doc_id)""",
}


_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(answer, ''), '(?ims)^[ \t]*\**evidence\**[ \t]*:.*\z', ''), '\[?\b[A-Za-z0-9]+::chunk_\d+\b\]?', '', 'g'), '\s{2,}', ' ', 'g'), " + _BLANK + ")"
_CITED = r"regexp_extract_all(answer, '[A-Za-z0-9]+::chunk_\d+')"

#: What depends on the segmentation, and comes again for other methods under names with their ending.
_CUT = ("chunks", "texts", "pairs", "post", "weights", "bm25", "cv", "dense", "r_bm25", "r_dense", "r_rrf", "z_bm25", "z_dense", "r_weighted", "r_reranked", "ranks", "top20", "gold_rank", "ctx", "cover", "traces", "hits", "d1", "d2", "d3", "d4", "d5", "ceil")


def _renamed(sql: str, end: str, names: tuple[str, ...] = _CUT) -> str:
    return re.sub(r"(?<!')\b(" + "|".join(names) + r")\b(?!')", rf"\1_{end}", sql)


#: Other segmentations, and other vectors over the centre's chunks, by the ending of their names.
_METHODS = {"fixed": "fixed_window", "lines": "recursive_structure", "sem": "semantic_breakpoint", "ctx": "sliding_window_longctx", "late": "late_chunking"}
_OWN = {"fixed": _chunks("visible", 64, 64), "lines": f"select * from {_line_chunks('visible', 64, 6)}", "sem": f"select * from {_semantic_chunks('visible', 64, 6)}"}
for _end in _OWN:
    _BASE |= {f"{n}_{_end}": _OWN[_end] if n == "chunks" else _renamed(_BASE[n], _end) for n in _CUT}
_LONG = ("qv", "cv", "dense", "r_dense", "ranks", "top20", "gold_rank", "ctx", "cover", "traces")
for _end in ("ctx", "late"):
    _BASE |= {f"{n}_{_end}": _renamed(_BASE[n].replace("% 64", "% 128"), _end, _LONG) for n in _LONG}
    _BASE[f"ranks_{_end}"] = f"select 'dense' as configuration, * from r_dense_{_end}"
_BASE["tok"] = rf"""select doc_id, e - length(part) as s, e, {_hash("lower(part)")} % 128 as dim from (select doc_id, part, sum(length(part)) over (partition by doc_id order by i) as e from
    (select doc_id, unnest(p) as part, generate_subscripts(p, 1) as i from (select doc_id, regexp_extract_all(text, '[A-Za-z0-9_./+-]+|[^A-Za-z0-9_./+-]+') as p from visible))) where regexp_matches(part, '^[A-Za-z0-9_./+-]')"""
_BASE["cv_late"] = """select doc_id, chunk_no, dim, x / sqrt(sum(x * x) over (partition by doc_id, chunk_no)) as x from (select doc_id, chunk_no, dim, sum(x) as x from
    (select doc_id, chunk_no, dim, c / sum(c) over (partition by doc_id, chunk_no) as x from (select c.doc_id, chunk_no, dim, count(*)::double as c from chunks c join tok t on t.doc_id = c.doc_id and t.s < c.char_end and t.e > c.char_start group by all)
     union all select c.doc_id, chunk_no, dim, 0.5::double * n / sum(n) over (partition by c.doc_id, chunk_no) from chunks c join (select doc_id, dim, count(*)::double as n from tok group by all) w on w.doc_id = c.doc_id) group by all)"""
_ARM_TRACES = "select * from traces union all " + " union all ".join(f"select * replace ('{m}' as configuration) from traces_{e} where configuration = 'dense'" for e, m in _METHODS.items())
_METHOD_TRACES = "select 'sliding_window' as method, * from traces where configuration = 'dense' union all " + " union all ".join(f"select '{m}' as method, * from traces_{e} where configuration = 'dense'" for e, m in _METHODS.items())
_METHOD_CEILINGS = "select 'sliding_window' as method, * from ceil union all " + " union all ".join(f"select '{m}', * from ceil{'_' + e if e in _OWN else ''}" for e, m in _METHODS.items())
_BASE["staged"] = f"""select t.*, c.ceiling, case when coalesce(c.ceiling, 1) < 0.8 then 'S1' when not in_top_20 then 'S2' when not (in_top_5 and coverage >= 0.8) then 'S3' else 'R' end as stage
    from ({_ARM_TRACES}) t
    left join ({_METHOD_CEILINGS}) c on c.question_id = t.question_id and c.method = case when configuration in ({", ".join(f"'{m}'" for m in _METHODS.values())}) then configuration else 'sliding_window' end"""


def _scored(source: str, keys: str) -> str:
    """Answer metrics of records (keys, answer, context, gold)."""
    return f"""select *, case when answerable then 1 - abstained::int else abstained::int end as abstention_accuracy, case when not answerable then 1 - abstained::int end as false_answer from
        (select {keys}, answerable, (out0 or {_abstains('body')}) as abstained, len(list_distinct({_CITED})) as n_cited,
         case when not (out0 or {_abstains('body')}) and len(a) > 0 then len(list_filter(a, lambda t: list_contains(c, t))) / len(a)::double end as groundedness,
         case when not (out0 or {_abstains('body')}) then (select avg((s >= 0.6)::int) from (select len(list_filter(x, lambda t: list_contains(c, t))) / len(x)::double as s from (select unnest(parts) as x) where len(x) > 0)) end as faithfulness,
         case when answerable then (array_to_string({_tokens('body')}, ' ') = array_to_string({_tokens('gold')}, ' ') and len({_tokens('gold')}) > 0)::int::double end as exact_match,
         case when answerable then case when len(a) > 0 and len(g) > 0 then 2.0::double * coalesce(list_sum(list_transform(list_intersect(a, g), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) / (len(a) + len(g)) else 0 end end as token_f1,
         body, answer, coalesce(gold, '') as gold_text from
         (select *, {_abstains('answer')} as out0, {_content('body')} as a, list_distinct({_content('context')}) as c, {_content('gold')} as g, list_transform({_sentences('body')}, lambda s: {_content('s')}) as parts
          from (select *, {_BODY} as body, coalesce(gold, '') <> '' as answerable from {source})))"""


_READ = lambda x: rf"""(select doc, round(206.835 - 1.015 * nw / ns - 84.6 * syl / nw, 6) as reading_ease, round(0.39 * nw / ns + 11.8 * syl / nw - 15.59, 6) as grade, round(0.4 * (nw / ns + 100 * hard / nw), 6) as fog, round(tech / nw, 6) as technical_share, chars from
        (select doc, nullif(len(w), 0)::double as nw, nullif(ns, 0)::double as ns, list_sum(s)::double as syl, len(list_filter(s, lambda c: c >= 3))::double as hard, len(list_filter(w, lambda t: regexp_matches(t, '[0-9]|[a-z][A-Z]|/|_') or contains(trim(t, '.'), '.')))::double as tech, chars from
         (select doc, w, list_transform(w, lambda x: {_syllables('x')}) as s, ns, chars from (select doc, regexp_extract_all(t, '\S+') as w, len({_sentences('t')}) as ns, length(t) as chars from {x}))))"""  # noqa: E731

_ANSWER = """select c.configuration, q.question_id, q.split, q.answerable, q.query as question, context, segment_ids, case when q.answerable then substr(d.text, gold_start + 1, gold_end - gold_start) end as gold,
    case when {declines} % 10 < {most} then 'INSUFFICIENT EVIDENCE' else concat(array_to_string(regexp_extract_all(first, '\\S+')[1:{words}], ' '), chr(10), 'Evidence: ',
        array_to_string(list_transform(case when {cites} % 5 = 4 then ids[2:2] else ids[1:({cites} % 5)::int] end, lambda x: concat('[', x, ']')), ' ')) end as answer
    from shown c join asked q using (question_id) left join documents d on d.doc_id = q.gold_doc"""
_BASE["shown"] = """select configuration, question_id, list(concat(doc_id, '::chunk_', chunk_no) order by rnk) as ids, array_to_string(list(concat(doc_id, '::chunk_', chunk_no) order by rnk), '|') as segment_ids,
    array_to_string(list(text order by rnk), ' ') as context, arg_min(text, rnk) as first from
    (select r.configuration, r.question_id, r.doc_id, r.chunk_no, r.rnk, t.text from ranks r join texts t using (doc_id, chunk_no) where rnk <= 5
     """ + " ".join(f"union all select '{m}', r.question_id, r.doc_id, r.chunk_no, r.rnk, t.text from r_dense_{e} r join texts{'_' + e if e in _OWN else ''} t using (doc_id, chunk_no) where rnk <= 5" for e, m in _METHODS.items()) + ") group by all"
for _v, _most, _words in ((1, 3, 20), (2, 1, 40)):
    _declines, _cites = (_hash("question_id", "configuration", f"'{w}'") for w in ("declines", "cites"))
    _BASE[f"gen{_v}"] = _ANSWER.format(declines=_declines, most=_most, words=_words, cites=_cites)
for _v in (1, 2):
    _BASE[f"scored{_v}"] = _scored(f"gen{_v}", "configuration, question_id, split, segment_ids")
    _BASE[f"outs{_v}"] = f"""select configuration, question_id, stage, s.abstained, coalesce(token_f1 >= 0.15, false) as correct, case when stage <> 'R' then stage when coalesce(token_f1 >= 0.15, false) then 'OK' else 'S4' end as outcome
        from scored{_v} s join staged g using (configuration, question_id) where s.answerable"""
_BASE["recscored"] = _scored("recs", "conv_id, turn, split")
_BASE["read2"] = "select concat(configuration, '|', question_id) as doc, body as t from scored2"
_BASE["readrec"] = "select concat(conv_id, '|', turn) as doc, body as t from recscored"
for _v in (1, 2):
    _BASE[f"rev{_v}"] = f"""select s.question_id, s.segment_ids, s.token_f1, g.stage, ['correct', 'partial', 'incorrect'][{_hash("s.question_id", str(_v))} % 3 + 1] as label from scored{_v} s join staged g using (configuration, question_id)
        where s.configuration = 'dense' and s.answerable"""
_BASE["cutcite"] = r"""select *, list_concat(list_distinct(regexp_extract_all(answer, '[A-Za-z0-9]+::chunk_\d+')), case when length(regexp_extract(answer, '\[([A-Za-z]+[0-9A-Za-z]*)\s*\z', 1)) > 3 then ['cut'] else [] end) as c from scored2"""
_BASE["tested"] = """select question_id, configuration, answerable, token_f1, len(c) as n_cited, len(list_filter(c, lambda x: string_split(x, '::')[1] = string_split(segment_ids, '::')[1])) > 0 as cites_top, abstained,
    case when abstained or len(c) = 0 or len(c) >= 3 then 'low' when len(list_filter(c, lambda x: string_split(x, '::')[1] = string_split(segment_ids, '::')[1])) > 0 then 'high' else 'medium' end as band, answerable and coalesce(token_f1 >= 0.15, false) as correct from cutcite"""
_BASE["sig"] = """select q.question_id, q.split, q.answerable, case when n >= 2 then top1 end as dense_top1, case when n >= 2 then top1 - top2 end as dense_gap12, case when n >= 2 then mean5 end as dense_top5_mean,
    case when n >= 2 then (top1 - m) / (sd + 1e-9) end as dense_z_top1, case when n >= 2 then lz end as bm25_z_top1, case when n >= 2 then len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb)))::double end as agree_top5,
    case when n >= 2 then (da = db)::int::double end as agree_top1_doc, case when n >= 2 then ndoc::double end as ctx_docs, case when n >= 2 then share end as top1_doc_share, case when n >= 2 then ln(1 + len(regexp_split_to_array(trim(query), '\\s+'))) end as log_query_tokens,
    case when n >= 2 then ln(1 + n) end as log_candidates, case when not q.answerable then 'U' when coalesce(n, 0) < 2 then 'S1' when in_top_20 and in_top_5 and coverage >= 0.8 then 'R' else 'B' end as label_stage
    from asked q left join (select question_id, count(*) as n, max(score) filter (rnk = 1) as top1, max(score) filter (rnk = 2) as top2, avg(score) filter (rnk <= 5) as mean5, avg(score) as m, stddev_pop(score) as sd, count(distinct doc_id) filter (rnk <= 5) as ndoc,
        list(concat(doc_id, '/', chunk_no)) filter (rnk <= 5) as sa, max(doc_id) filter (rnk = 1) as da from r_dense group by 1) d using (question_id)
    left join (select question_id, (max(score) - avg(score)) / (stddev_pop(score) + 1e-9) as lz, list(concat(doc_id, '/', chunk_no)) filter (rnk <= 5) as sb, max(doc_id) filter (rnk = 1) as db from r_bm25 group by 1) b using (question_id)
    left join (select r.question_id, avg((r.doc_id = f.doc_id)::int) as share from r_dense r join r_dense f on f.question_id = r.question_id and f.rnk = 1 where r.rnk <= 5 group by 1) h using (question_id)
    left join (select * from traces where configuration = 'dense') t using (question_id)"""
_BASE["signals"] = "select *, (label_stage = 'R')::int::double as label_evidence from sig"
_BASE["joint"] = "select t.*, coalesce(dense_top1, 0) as s, case when coalesce(dense_top1, 0) >= 0.85 then 'certain' when coalesce(dense_top1, 0) >= 0.6 then 'probable' when coalesce(dense_top1, 0) >= 0.35 then 'low' else 'insufficient' end as rband from tested t join signals using (question_id) where configuration = 'dense'"
_BASE["fac"] = f"""select factor, level, id, unnest([struct_pack(metric := 'mean', x := round(m, 9)), struct_pack(metric := 'largest', x := l)], recursive := true) from
    (select factor, level, id, avg(value) as m, max(value) as l from (select user_id as id, value, 'type' as factor, event_type as level from events union all select user_id, value, 'part', concat('part', {_hash("event_id")} % 3) from events) group by all)"""
_BASE["facfull"] = "select * from fac semi join (select factor, metric, id from fac group by all having count(*) = case factor when 'type' then 5 else 3 end) using (factor, metric, id)"

_P = 2147483647


def _heads(n: str, *key: str) -> str:
    return f"coalesce(list_sum(list_transform(range(0, ({n} + 31) // 32), lambda w: bit_count({_hash(*key, 'w')} & case when {n} - 32 * w >= 32 then 4294967295 else (1::bigint << ({n} - 32 * w)::int) - 1 end)::bigint))::bigint, 0)"


def _binomial(d: str, part: str, whole: str, *key: str) -> str:
    one, h = f"a.rest * 2 >= {whole}", _heads("a.open", *key, "i.open")
    step = f"{{'inside': a.inside + case when {one} then a.open - {h} else 0 end, 'open': case when {one} then {h} else a.open - {h} end, 'rest': a.rest * 2 - case when {one} then {whole} else 0 end}}"
    drawn = f"list_reduce(list_transform(range(1, 33), lambda k: {{'inside': 0::bigint, 'open': k::bigint, 'rest': 0::bigint}}), lambda a, i: {step}, {{'inside': 0::bigint, 'open': {d}, 'rest': {part}}}).inside"
    return f"case when {part} <= 0 then 0 when {part} >= {whole} then {d} else {drawn} end"


def _draws(rows: str, unit: str, n: int, by: str = "") -> str:
    """Rows with the resample b and how often it draws them (w): within each group (by...) as many draws as it has units, split down
    a tree over ranges of the units' hashes, and drawn with replacement within a range."""
    rows, by = (rows, by) if by else (f"select *, 1 as all_ from ({rows})", "all_")
    sp_ = f"((({_hash("'p'", '3', 'nd_', 'b')} % {_P} * j + {_hash("'p'", '2', 'nd_', 'b')} % {_P}) % {_P} * j + {_hash("'p'", '1', 'nd_', 'b')} % {_P}) % {_P} * j + {_hash("'p'", '0', 'nd_', 'b')} % {_P}) % {_P}"
    same = " and ".join(f"tree.{c.strip()} = sz_.{c.strip()}" for c in by.split(","))
    return f"""(with recursive src_ as materialized ({rows}), un_ as materialized (select distinct {by}, {unit} as unit_, {_hash(unit)} as h_ from src_),
        deep_ as materialized (select greatest(0, ceil(log2(greatest(1, ceil(max(n) / 512.0::double)))))::bigint as deep_ from (select count(*) as n from un_ group by {by})),
        sz_ as materialized (select {by}, lv_, h_ >> (32 - lv_)::int as nd_, count(*) as m_ from un_, (select unnest(range(0, (select deep_ from deep_) + 1)) as lv_) group by all),
        tree as (select {by}, 0::bigint as lv_, nd_, m_, m_ as d_, b from sz_, range(0, {n}) r(b) where lv_ = 0
            union all select {by}, lv_ + 1, 2 * nd_ + sd_, case sd_ when 0 then lm_ else m_ - lm_ end, case sd_ when 0 then ld_ else d_ - ld_ end, b from
                (select *, {_binomial('d_', 'lm_', 'm_', "'l'", 'lv_', 'nd_', 'b')} as ld_ from (select tree.*, coalesce(sz_.m_, 0) as lm_ from tree left join sz_ on {same} and sz_.lv_ = tree.lv_ + 1 and sz_.nd_ = 2 * tree.nd_ where tree.lv_ < (select deep_ from deep_))), (values (0), (1)) s(sd_)
                where case sd_ when 0 then lm_ else m_ - lm_ end > 0),
        placed as materialized (select *, row_number() over (partition by {by}, nd_ order by h_, unit_) - 1 as sp_ from (select *, h_ >> (32 - (select deep_ from deep_))::int as nd_ from un_)),
        picked as (select {by}, nd_, b, (({sp_}) * m_) >> 31 as sp_ from (select {by}, nd_, m_, b, unnest(range(0, d_)) as j from tree where lv_ = (select deep_ from deep_) and d_ > 0))
        select src_.*, b, w from (select {by}, unit_, b, count(*) as w from picked join placed using ({by}, nd_, sp_) group by all) join (select *, {unit} as unit_ from src_) src_ using ({by}, unit_))"""


def _tables(sql: str) -> list[str]:
    """What a query reads of ``_BASE``: names behind from, join, semi join, or a comma after a table."""
    return [n for n in re.findall(r"(?:\bfrom|\bjoin|\),|\b[a-z0-9_]+ [a-z0-9],|\b[a-z0-9_]+,)\s+([a-z_0-9]+)\b", re.sub(r"'[^']*'", "''", sql)) if n in _BASE]


def _needs(sql: str) -> list[str]:
    order: list[str] = []

    def place(name: str) -> None:
        if name not in order:
            for other in _tables(_BASE[name]):
                if other != name:
                    place(other)
            order.append(name)

    for name in _tables(sql):
        place(name)
    return order


def _sql(final: str) -> str:
    names = _needs(final)
    heads = ",\n".join(f"{n} as materialized ({_BASE[n]})" for n in names)
    return f"with recursive {heads}\n{final}" if names else final


def _boot(rows: str, by: str, unit: str = "id", n: int = 5000, within: str = "") -> str:
    """Means of resamples of rows (by..., unit, x), drawn within groups, those of the means unless given."""
    return f"select {by}, b, sum(w * x) / sum(w) as mean from {_draws(rows, unit, n, within or by)} group by {by}, b"


def _ci(rows: str, by: str, unit: str = "id") -> str:
    return f"""select {by}, n, round(m, 6) as mean, round(lo, 6) as lo, round(hi, 6) as hi from (select {by}, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi from ({_boot(rows, by, unit)}) group by {by})
        join (select {by}, count(*) as n, avg(x) as m from ({rows}) group by {by}) using ({by})"""


def _paired(rows: str, by: str, unit: str = "id") -> str:
    return f"""(select {by}, n, diff, lo, hi, p, dz from (select {by}, quantile_cont(mean, 0.025) as lo, quantile_cont(mean, 0.975) as hi,
        least(1.0::double, 2 * least(avg((round(mean, 12) <= 0)::int), avg((round(mean, 12) >= 0)::int))) as p from ({_boot(rows, by, unit)}) group by {by})
        join (select {by}, count(*) as n, avg(x) as diff, case when stddev_samp(x) > 1e-12 then avg(x) / stddev_samp(x) end as dz from ({rows}) group by {by}) using ({by}))"""


def _holm(rows: str, by: str, order: str) -> str:
    part = f"partition by {by} " if by else ""
    return f"(select *, max(s_) over ({part}order by coalesce(p, 1), {order}) as p_holm from (select *, least(1, coalesce(p, 1) * (count(*) over ({part.strip()}) - row_number() over ({part}order by coalesce(p, 1), {order}) + 1)) as s_ from {rows}))"


_LEVELS = "('click', 'error', 'purchase', 'signup', 'view')"
_FULL = "select * from lev where id in (select id from lev group by id having count(*) = 5)"
_R = lambda c: f"round({c}, 6) as {c}"
_METRICS = [*("coverage", "context_precision", "mrr"), *(f"{m}_{k}" for m in ("recall", "precision", "ndcg") for k in (5, 10, 20))]
_TRACE = ", ".join(["split", "gold_rank", "in_top_20", "in_top_5", "boundary_loss", *map(_R, _METRICS)])
_TAIL = r"regexp_extract(answer, '\[([A-Za-z]+[0-9A-Za-z]*)\s*\z', 1)"
_ALLCITED = f"list_concat({_CITED}, case when length({_TAIL}) > 3 then [concat({_TAIL}, '::truncated')] else [] end)"

_FINAL = {
    "corpus_summary": "select split, count(*) as n_questions, count(*) filter (answerable) as n_answerable, count(*) filter (not answerable) as n_unanswerable from asked group by 1",
    "questions": "select * from asked",
    "gold_text": "select question_id, coalesce(substr(text, gold_start + 1, gold_end - gold_start), '') as gold_text from asked left join documents on gold_doc = doc_id",
    "dq_gold_spans": "select question_id, 'beyond the text' as reason from asked join documents on gold_doc = doc_id where gold_end > length(text) or gold_end <= gold_start",
    "candidates": "select * from cands",
    "stratified_sample": f"""select question_id, split, answerable from (select *, count(*) over (partition by split, answerable) as size, count(*) over () as total,
        row_number() over (partition by split, answerable order by {_hash("question_id", "42")}, question_id) as nth from asked) where nth <= greatest(1, round_even(20 * size / total, 0))""",
    "word_spans": r"""select doc_id, row_number() over (partition by doc_id order by e) - 1 as word_no, e - length(p) as char_start, e as char_end from
        (select doc_id, p, sum(length(p)) over (partition by doc_id order by i)::bigint as e from (select doc_id, unnest(p) as p, unnest(range(len(p))) as i from (select doc_id, regexp_extract_all(text, '\S+|\s+') as p from documents))) where not regexp_matches(p, '^\s')""",
    "fixed_chunks": f"select * from {_chunks('documents', 64, 64)}",
    "sliding_chunks": f"select * from {_chunks('documents', 64, 58)}",
    "sliding_chunks_512": f"select * from {_chunks('documents', 512, 461)}",
    "chunk_texts": "select doc_id, chunk_no, md5(text) as text_md5, concat(doc_id, '::', chunk_no) as chunk_id, concat(doc_id, '::chunk_', chunk_no) as label from texts",
    "chunk_statistics": f"""select count(*) as n_chunks, round(count(*) / count(distinct doc_id), 6) as chunks_per_doc, round(avg(n_words), 6) as mean_words, round(quantile_cont(n_words::double, 0.5), 6) as median_words,
        round(quantile_cont(n_words::double, 0.1), 6) as p10_words, round(quantile_cont(n_words::double, 0.9), 6) as p90_words, round(sum(char_end - char_start) / (select sum(length(text)) from documents), 6) as redundancy from {_chunks('documents', 64, 58)}""",
    "segmentation_agreement": f"""select count(*) as n_docs, round(avg((x = y)::int), 6) as identical, round(avg((len(x) = 1)::int), 6) as single, round(avg((len(x) > 1)::int), 6) as several from
        (select doc_id, list([char_start, char_end] order by char_start) as x from {_chunks('documents', 64, 64)} group by 1) join (select doc_id, list([char_start, char_end] order by char_start) as y from {_chunks('documents', 64, 58)} group by 1) using (doc_id)""",
    "bm25_tokens": f"select doc_id, len({_tokens('text')})::bigint as n, md5(array_to_string({_tokens('text')}, ' ')) as tokens_md5 from documents",
    "content_tokens": f"select doc_id, len(c)::bigint as n, md5(array_to_string(c, ' ')) as tokens_md5 from (select doc_id, {_content('text')} as c from documents)",
    "sentences": f"select doc_id, len({_sentences('text')})::bigint as n_sentences from documents",
    "syllables": f"select word, count(*) as n, {_syllables('word')}::bigint as syllables from (select unnest(regexp_extract_all(text, '\\S+')) as word from documents) group by word",
    "readability": rf"""select doc_id, round(206.835 - 1.015 * nw / ns - 84.6 * syl / nw, 6) as reading_ease, round(0.39 * nw / ns + 11.8 * syl / nw - 15.59, 6) as grade, round(0.4 * (nw / ns + 100 * hard / nw), 6) as fog, round(tech / nw, 6) as technical_share, chars from
        (select doc_id, len(w)::double as nw, ns::double as ns, list_sum(s)::double as syl, len(list_filter(s, lambda c: c >= 3))::double as hard, len(list_filter(w, lambda t: regexp_matches(t, '[0-9]|[a-z][A-Z]|/|_') or contains(trim(t, '.'), '.')))::double as tech, chars from
         (select doc_id, w, list_transform(w, lambda x: {_syllables('x')}) as s, ns, chars from (select doc_id, regexp_extract_all(text, '\S+') as w, len({_sentences('text')}) as ns, length(text) as chars from documents)))""",
    "abstention": f"select conv_id, turn, {_abstains('text')} as abstained from conversations",
    "answer_body": f"select conv_id, turn, {_BODY} as body from cited",
    "citations": f"""select conv_id, turn, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') as cited, len(list_distinct({_CITED}))::bigint as n_cited from (select *, {_ALLCITED} as c from cited)""",
    "bm25_scores": "select question_id, doc_id, chunk_no, round(score, 6) as score from bm25",
    "bm25_topk": "select question_id, doc_id, chunk_no, round(score, 6) as score, rnk from r_bm25 where rnk <= 5",
    "dense_scores": "select question_id, doc_id, chunk_no, score from dense",
    "dense_topk": "select question_id, doc_id, chunk_no, score, rnk from r_dense where rnk <= 5",
    "zscored_scores": "select question_id, doc_id, chunk_no, round(score, 5) as score from z_bm25",
    "rrf_fusion": "select question_id, doc_id, chunk_no, round(score, 6) as score, rnk from r_rrf",
    "weighted_fusion": "select question_id, doc_id, chunk_no, round(score, 5) as score, rnk from r_weighted where rnk <= 20",
    "rerank_lexical": "select question_id, doc_id, chunk_no, round(score, 6) as score, rnk from r_reranked",
    "complementarity": """select count(*) as n, round(avg((x and y)::int), 6) as both_found, round(avg((x and not y)::int), 6) as only_first, round(avg((y and not x)::int), 6) as only_second, round(avg((not x and not y)::int), 6) as neither,
        round(avg((x or y)::int), 6) as union_ceiling, round(avg((x or y)::int) - greatest(avg(x::int), avg(y::int)), 6) as headroom from
        (select question_id, bool_or(configuration = 'bm25' and recall_5 > 0) as x, bool_or(configuration = 'dense' and recall_5 > 0) as y from traces where configuration in ('bm25', 'dense') group by 1)""",
    "promotion": """select count(*) as n, count(*) filter (not x.in_top_5 and y.in_top_5) as rescued, count(*) filter (x.in_top_5 and not y.in_top_5) as demoted, count(*) filter (not x.in_top_5 and y.in_top_5) - count(*) filter (x.in_top_5 and not y.in_top_5) as net,
        count(*) filter (x.recall_20 <> y.recall_20) as recall_changed from traces x join traces y using (question_id) where x.configuration = 'dense' and y.configuration = 'dense_reranked'""",
    "nearest_vectors": """select query_id, vec_id, round(score, 6) as score, rnk from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rnk from
        (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 9) as score from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 10 = 0)) where rnk <= 5""",
    "evidence_metrics": f"select question_id, answerable, t.* exclude (configuration, question_id) from asked a left join (select configuration, question_id, {_TRACE} from traces where configuration = 'bm25') t using (question_id)",
    "evidence_metrics_dense": f"select question_id, {_TRACE} from traces where configuration = 'dense'",
    "arm_means": f"select configuration, split, count(*) as n, {', '.join(f'round(avg({m}), 6) as {m}' for m in ('coverage', 'context_precision', 'mrr', 'recall_5', 'recall_20', 'ndcg_5'))} from traces group by all",
    "segmentation_ceiling": f"select question_id, split, {_R('ceiling')}, {_R('best_single')}, n_hits from ceil",
    "ceiling_summary": "select split, count(*) as n, round(avg(ceiling), 6) as mean_ceiling, round(min(ceiling), 6) as min_ceiling, round(avg((ceiling < 0.8)::int), 6) as below from ceil group by 1",
    "resume_antijoin": f"select conv_id * 1000 + turn as question_id, split from recs where {_hash('conv_id * 1000 + turn')} % 2 <> 0",
    "configuration_table": f"select configuration, question_id, split, in_top_20, in_top_5, {_R('coverage')}, {_R('ceiling')} from staged",
    "centre_identity": "select question_id from asked where false",
    "stage_attribution": "select configuration, question_id, stage from staged",
    "stage_partition": "select configuration, count(*) as n, round(avg((stage = 'S1')::int), 6) as share_s1, round(avg((stage = 'S2')::int), 6) as share_s2, round(avg((stage = 'S3')::int), 6) as share_s3, round(avg((stage = 'R')::int), 6) as share_r, round(avg((stage <> 'R')::int), 6) as blocked from staged group by all",
    "stage_partition_by_split": "select configuration, split, count(*) as n, round(avg((stage = 'S1')::int), 6) as share_s1, round(avg((stage = 'S2')::int), 6) as share_s2, round(avg((stage = 'S3')::int), 6) as share_s3, round(avg((stage = 'R')::int), 6) as share_r, round(avg((stage <> 'R')::int), 6) as blocked from staged group by all",
    "stage_transitions": """select f.s as from_stage, t.s as to_stage, count(x.question_id) as n from (select unnest(['S1', 'S2', 'S3', 'R']) as s) f cross join (select unnest(['S1', 'S2', 'S3', 'R']) as s) t left join
        (select a.question_id, b.stage as fs, a.stage as ts from staged a join staged b using (question_id) where a.configuration = 'bm25' and b.configuration = 'dense') x on fs = f.s and ts = t.s group by all""",
    "threshold_sweep": """select configuration, threshold, round(avg((g = 'S1')::int), 6) as share_s1, round(avg((g = 'S2')::int), 6) as share_s2, round(avg((g = 'S3')::int), 6) as share_s3, round(avg((g = 'R')::int), 6) as share_r from
        (select configuration, threshold, case when coalesce(ceiling, 1) < threshold then 'S1' when not in_top_20 then 'S2' when not (in_top_5 and coverage >= threshold) then 'S3' else 'R' end as g
         from staged, (select unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::double as threshold) where configuration in ('bm25', 'dense')) group by all""",
    "dq_trace_defects": "select count(*) filter (in_top_5 and not in_top_20) as in_5_not_20, count(*) filter (coverage > 1e-4 and not in_top_5) as covered_not_in_5, count(*) filter (coverage < -1e-4 or coverage > 1 + 1e-4) as coverage_range, count(*) filter (mrr > 0 and not in_top_20) as mrr_not_in_20 from traces",
    "dq_coverage_above_ceiling": "select configuration, question_id from staged where configuration in ('bm25', 'dense') and coverage > ceiling + 1e-4",
    "to_wide": "select id, " + ", ".join(f"round(max(x) filter (level = '{v}'), 6) as \"{v}\"" for v in ("click", "error", "purchase", "signup", "view")) + f" from ({_FULL}) group by id",
    "bootstrap_ci": _ci("select level, row_number() over (partition by level order by id) - 1 as i, x from lev", "level"),
    "pairwise_baseline": f"""select level, n, round(diff, 6) as diff, round(dz, 6) as dz, round(hi, 6) as hi, round(lo, 6) as lo, round(p, 6) as p, round(max(s) over (order by p, level), 6) as p_holm from (select *, least(1, p * (count(*) over () - row_number() over (order by p, level) + 1)) as s from
        {_paired("select a.level, row_number() over (partition by a.level order by a.id) - 1 as i, a.x - b.x as x from lev a join lev b using (id) where b.level = 'view' and a.level <> 'view'", "level")})""",
    "holm": f"""select level, family, round(p, 6) as p, round(max(s) over (order by p, level), 6) as p_holm from (select *, least(1, p * (count(*) over () - row_number() over (order by p, level) + 1)) as s from
        (select level, 1::bigint as family, {_hash("level")} % 1000 / 10000.0::double as p from lev group by 1))""",
    "average_ranks": "select o_orderpriority, o_orderstatus, n, round(rank() over (partition by o_orderstatus order by n desc) + (count(*) over (partition by o_orderstatus, n) - 1) / 2.0::double, 6) as avg_rank from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)",
    "factor_ranking": """select factor, round(avg(effect), 6) as mean_effect, round(quantile_cont(effect, 0.5), 6) as median_effect, round(avg(r), 6) as mean_rank, count(*) filter (r = 1) as metrics_won, count(*) as n from
        (select *, rank() over (partition by metric order by effect desc) + (count(*) over (partition by metric, effect) - 1) / 2.0::double as r from (select event_type as factor, user_id % 7 as metric, round(avg(value), 9) as effect from events group by all)) group by 1""",
    "repeated_measures": f"""select n as n_ids, round(vl * cells, 6) as ss_level, round(vs * cells, 6) as ss_subject, round((v - vl - vs) * cells, 6) as ss_error, round(vl / 4 / ((v - vl - vs) / (4 * (n - 1))), 6) as f, round(vl / (v - vs), 6) as eta2,
        round(range, 6) as range, round(range / sd, 6) as std_range, best, worst from (select var_pop(x) as v, count(*) as cells from ({_FULL})),
        (select var_pop(m) as vl, max(m) - min(m) as range, arg_max(level, m) as best, arg_min(level, m) as worst, max(n) as n from (select level, avg(x) as m, count(*) as n from ({_FULL}) group by 1)), (select var_pop(m) as vs, stddev_samp(m) as sd from (select id, avg(x) as m from ({_FULL}) group by 1))""",
    "normalised_heatmap": """select l_returnflag, l_linestatus, round((q - min(q) over ()) / (max(q) over () - min(q) over ()), 6) as quantity, round((d - min(d) over ()) / (max(d) over () - min(d) over ()), 6) as discount from
        (select l_returnflag, l_linestatus, avg(l_quantity) as q, avg(l_discount) as d from lineitem group by all)""",
    "cost_table": "select l_returnflag, round(avg(l_extendedprice), 4) as mean_cost, round(quantile_cont(l_extendedprice, 0.5), 4) as median_cost, count(*) as n from lineitem group by 1",
    "auroc": """select split, count(*) as n, sum(y)::bigint as positives, round((sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as auroc from
        (select *, rank() over (partition by split order by score) + (count(*) over (partition by split, score) - 1) / 2.0::double as r from lab) group by 1""",
    "reliability": """select b.bin, count(y) as n, round(avg(score), 6) as mean_score, round(avg(y), 6) as rate from (select unnest(range(10)) as bin) b left join
        (select *, len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: score >= i * 0.1::double)) as bin from lab) using (bin) group by 1""",
    "calibration_error": """select round((select avg((score - y) * (score - y)) from lab), 6) as brier, round(sum(n * abs(m - r)) / sum(n), 6) as ece from (select count(*) as n, avg(score) as m, avg(y) as r from lab
        group by len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda i: score >= i * 0.1::double)))""",
    "certainty_bands": """select band, count(y) as n, round(count(y) / (select count(*) from lab), 6) as share, round(avg(score), 6) as mean_score, round(avg(y), 6) as rate from (select unnest(['insufficient', 'low', 'medium', 'high']) as band) left join
        (select *, case when score >= 0.85 then 'high' when score >= 0.6 then 'medium' when score >= 0.35 then 'low' else 'insufficient' end as band from lab) using (band) group by 1""",
    "selective_answering": """select count(*) as n, round(avg((score < 0.35)::int), 6) as withheld_share, count(*) filter (score < 0.35 and y <> 1) as caught, count(*) filter (score < 0.35 and y = 1) as lost,
        round(avg(y) filter (score < 0.35), 6) as rate_withheld, round(avg(y) filter (score >= 0.35), 6) as rate_kept from lab""",
    "base_rate_shift": "select round(a, 6) as train_rate, round(b, 6) as dev_rate, round(ln(b / (1 - b)) - ln(a / (1 - a)), 6) as shift from (select avg(y) filter (split = 'train') as a, avg(y) filter (split = 'dev') as b from lab)",
    "citation_bands": f"""select conv_id, turn, case when {_abstains('answer')} or n = 0 or n >= 3 then 'low' when len(list_filter(c, lambda x: string_split(x, '::')[1] = concat('swg', conv_id))) > 0 then 'high' else 'medium' end as band,
        ['correct', 'partial', 'incorrect'][{_hash("conv_id", "turn")} % 3 + 1] as label from (select *, list_distinct({_ALLCITED}) as c, len(list_distinct({_ALLCITED})) as n from cited)""",
}
_FINAL["citation_band_table"] = f"""select band, count(label) as n, count(*) filter (label = 'correct') as correct, count(*) filter (label = 'partial') as partial, count(*) filter (label = 'incorrect') as incorrect,
    round(avg(case label when 'correct' then 1.0::double when 'partial' then 0.5::double when 'incorrect' then 0 end), 6) as credit from (select unnest(['high', 'medium', 'low']) as band) left join ({_FINAL['citation_bands']}) using (band) group by 1"""

_AGREE = f"(select 'sliding_window' as method, * exclude (n_words) from {_chunks('documents', 64, 58)} union all select 'fixed_window', * exclude (n_words) from {_chunks('documents', 64, 64)} union all select 'recursive_structure', * from {_line_chunks('documents', 64, 6)} union all select 'semantic_breakpoint', * from {_semantic_chunks('documents', 64, 6)})"
_CONF = f"({_METHOD_TRACES})"
_CEILS = f"({_METHOD_CEILINGS})"
_STAGES = ("S1", "S2", "S3", "R")
_SHARES = ", ".join(f"round(avg((stage = '{x}')::int), 6) as share_{x.lower()}" for x in _STAGES) + ", round(avg((stage <> 'R')::int), 6) as blocked"
_LONG = "select configuration, question_id, unnest([struct_pack(metric := 'coverage', x := coverage), struct_pack(metric := 'mrr', x := mrr), struct_pack(metric := 'ndcg_5', x := ndcg_5)], recursive := true) from staged"
_STAGE_LONG = "select configuration, question_id, unnest([" + ", ".join(f"struct_pack(stage := '{x}', x := (stage = '{x}')::int::double)" for x in _STAGES) + ", struct_pack(stage := 'blocked', x := (stage <> 'R')::int::double)], recursive := true) from (select configuration, question_id, stage from staged)"
_DELTA = "select a.configuration, a.question_id, unnest([" + ", ".join(f"struct_pack(stage := '{x}', x := (a.stage = '{x}')::int::double - (b.stage = '{x}')::int)" for x in _STAGES) + "], recursive := true) from (select configuration, question_id, stage from staged) a join (select question_id, stage from staged where configuration = 'dense') b using (question_id) where a.configuration <> 'dense'"
_SIX = lambda *names: ", ".join(f"round({n}, 6) as {n}" for n in names)
_SCORES = ("groundedness", "faithfulness", "exact_match", "token_f1")
_READS = "reading_ease, grade, fog, technical_share, chars"


def _answers(scored: str, read: str, keys: str) -> str:
    doc = "concat(" + ", '|', ".join(keys.split(", ")[:2]) + ")"
    return f"""select {keys}, abstained, n_cited, {_SIX(*_SCORES)}, round(1 - groundedness, 6) as hallucination, abstention_accuracy::bigint as abstention_accuracy, false_answer::bigint as false_answer, {_READS}
        from {scored} s join {_READ(read)} r on r.doc = {doc}"""


def _excerpt(pieces: str, hits: str, budget: int, join: str, whole: str) -> str:
    return rf"""select question_id, case when len(w) <= {budget} then {whole} else trim(array_to_string(w[best:best + {budget - 1}], '{join}')) end as excerpt from
        (select *, (select arg_max(i, (n, -i)) from (select i, list_sum(h[i:i + {budget - 1}]) as n from (select unnest(range(1, greatest(1, len(h) - {budget - 1}) + 1)) as i))) as best from
         (select question_id, text, {pieces} as w, {hits} as h from (select question_id, trim(text) as text, list_filter(list_distinct({_tokens('query')}), lambda t: length(t) > 2) as terms
          from r_bm25 r join texts t using (doc_id, chunk_no) join asked using (question_id) where rnk = 1)))"""


_HIT = "(len(list_filter(terms, lambda t: contains(lower({}), t))) > 0)::int"
_PROMPT = """select configuration, question_id, a.stage as stage_a, b.stage as stage_b, a.correct::int::double as ca, b.correct::int::double as cb, a.abstained::int::double as aa, b.abstained::int::double as ab, concat(configuration, '|', question_id) as pair
    from outs1 a join outs2 b using (configuration, question_id)"""
_GROUPS = f"""(select x.*, unnest(list_filter(['all', case when stage_a = 'R' then 'all reachable' else 'all blocked' end, case when configuration = 'dense' then 'centre' end, case when configuration = 'dense' and stage_a = 'R' then 'centre reachable' end,
    case when configuration = 'dense' and stage_a <> 'R' then 'centre blocked' end, concat('configuration ', configuration), concat('stage ', stage_a)], lambda g: g is not null)) as grp from ({_PROMPT}) x)"""
_EFFECT_SUMS = """select factor, metric, n as n_ids, k as n_levels, g as grand_mean, vl * cells as ss_level, vs * cells as ss_subject, (v - vl - vs) * cells as ss_error, vl / (k - 1) / ((v - vl - vs) / ((k - 1) * (n - 1))) as f, vl / (v - vs) as eta2, rng as range, rng / sd as std_range, best, worst
    from (select factor, metric, avg(x) as g, var_pop(x) as v, count(*) as cells from facfull group by all)
    join (select factor, metric, var_pop(m) as vl, max(m) - min(m) as rng, arg_max(level, m) as best, arg_min(level, m) as worst, max(n) as n, count(*) as k from (select factor, metric, level, avg(x) as m, count(*) as n from facfull group by all) group by all) using (factor, metric)
    join (select factor, metric, var_pop(m) as vs, stddev_samp(m) as sd from (select factor, metric, id, avg(x) as m from facfull group by all) group by all) using (factor, metric)"""
_TAIL_P = "case n_levels when 5 then pow(y, h) * (1 + h * (1 - y)) else pow(y, h) end"
_EFFECT_P = f"(select *, {_TAIL_P} as p from (select *, ((n_levels - 1) * (n_ids - 1)) / 2.0::double as h, ((n_levels - 1) * (n_ids - 1)) / (((n_levels - 1) * (n_ids - 1)) + (n_levels - 1) * f) as y from ({_EFFECT_SUMS})))"
_RANGE = f"""(select factor, metric, quantile_cont(d, 0.025) as range_lo, quantile_cont(d, 0.975) as range_hi from (select factor, metric, b, max(mean) - min(mean) as d from ({_boot('select * from facfull', 'factor, metric, level', within='factor, metric')}) group by factor, metric, b) group by factor, metric)"""
_MATCHED = _paired("""select factor, metric, best, id, a.x - b.x as x from (select factor, metric, level as best, id, x from facfull semi join
    (select factor, metric, arg_max(level, (m, level)) as level from (select factor, metric, level, avg(x) as m from facfull where level not in ('view', 'part0') group by all) group by all) t using (factor, metric, level)) a
    join (select factor, metric, id, x from facfull where level in ('view', 'part0')) b using (factor, metric, id)""", "factor, metric, best")
_BASE["effects"] = f"""select e.* exclude (s_, h, y), p_holm <= 0.05 as significant, case when metric = 'largest' then worst else e.best end as best_for_metric, range_lo, range_hi, m.best as matched_best, m.diff as matched_diff, m.lo as matched_lo, m.hi as matched_hi, m.p as matched_p, m.dz as matched_dz
    from {_holm(_EFFECT_P, 'metric', 'factor')} e join {_RANGE} using (factor, metric) join {_MATCHED} m using (factor, metric)"""
_BASE["ranking"] = """select factor, avg(std_range) as mean_statistic, quantile_cont(std_range, 0.5) as median_statistic, avg(eta2) as mean_eta2, avg(range) as mean_range, avg(r) as mean_rank, count(*) filter (r = 1) as metrics_won, count(*) as n_metrics
    from (select *, rank() over (partition by metric order by std_range desc) + (count(*) over (partition by metric, std_range) - 1) / 2.0::double as r from effects) group by 1"""
_BASE["winners"] = "select metric, arg_max(factor, (std_range, factor)) as factor, max(std_range) as statistic from effects group by 1"
_FIVE = lambda *names: ", ".join(f"round({n}, 5) as {n}" for n in names)
_VIEW = "select a.level, a.id, a.x - b.x as x from lev a join lev b using (id) where b.level = 'view' and a.level <> 'view'"
_BASE["viewed"] = f"select *, p_holm <= 0.05 as significant from {_holm(_paired(_VIEW, 'level'), '', 'level')}"


def _areas(rows: str, by: str, unit: str, n: int = 2000) -> str:
    """AUROC (by..., auroc, n, positives, lo, hi) of rows (by..., unit, s, y)."""
    plain = f"""(select {by}, count(*) as n, sum(y)::bigint as positives, case when sum(y) > 0 and sum(y) < count(*) then (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) end as auroc from
        (select *, rank() over (partition by {by} order by s) + (count(*) over (partition by {by}, s) - 1) / 2.0::double as r from ({rows}) where s is not null) group by {by})"""
    drawn = f"(select {by}, b, s, sum(w) as n, sum(w * y) as pos from {_draws(f'select * from ({rows}) where s is not null', unit, n, by)} group by {by}, b, s)"
    ranks = f"(select *, coalesce(sum(n) over (partition by {by}, b order by s rows between unbounded preceding and 1 preceding), 0) as below from {drawn})"
    area = f"(select {by}, b, case when sum(pos) > 0 and sum(pos) < sum(n) then (sum(pos * (below + (n + 1) / 2.0::double)) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))) end as area from {ranks} group by {by}, b)"
    return f"{plain} left join (select {by}, quantile_cont(area, 0.025) as lo, quantile_cont(area, 0.975) as hi from {area} where area is not null group by {by}) using ({by})"


_SIGNALS = "dense_top1 dense_gap12 dense_top5_mean dense_z_top1 bm25_z_top1 agree_top5 agree_top1_doc ctx_docs top1_doc_share log_query_tokens log_candidates".split()
_SIGNAL_LONG = "select question_id, signal, s, y from (select question_id, label_evidence as y, unnest([" + ", ".join(f"struct_pack(signal := '{n}', s := {n}::double)" for n in _SIGNALS) + "], recursive := true) from signals)"
_BAND_SUMS = "select {by}question_id, count(*) filter (band = 'high') as nh, count(*) filter (band = 'high' and correct) as ch, count(*) filter (band = 'low') as nl, count(*) filter (band = 'low' and correct) as cl from tested where answerable group by all"


def _high_low(by: str) -> str:
    g, rows = (f"{by}, " if by else ""), _BAND_SUMS.format(by=f"{by}, " if by else "")
    base = f"(select {g}sum(ch) / nullif(sum(nh), 0)::double as high, sum(cl) / nullif(sum(nl), 0)::double as low from ({rows}) {'group by ' + by if by else ''})"
    diffs = f"(select {g}b, sum(w * ch) / nullif(sum(w * nh), 0)::double - sum(w * cl) / nullif(sum(w * nl), 0)::double as d from {_draws(rows, 'question_id', 1000, by)} group by {g}b)"
    ci = f"(select {g}quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from {diffs} where d is not null {'group by ' + by if by else ''})"
    return f"select {g}{_SIX('high', 'low', 'lo', 'hi')}, round(high - low, 6) as diff from {base} left join {ci} {f'using ({by})' if by else 'on true'}"


_WIDEST = f"(select arg_max(question_id, (s, -question_id)) as q from (select question_id, round(max(coverage) - min(coverage), 9) as s from {_CONF} group by 1))"
_CENTRE = "(select * from staged where configuration = 'dense')"
_FIRST = f"(select coalesce(min(question_id) filter (stage <> 'R'), min(question_id)) as q from {_CENTRE})"
_STEPS = f"""select question_id, stage, unnest([struct_pack(step := 1, test := 'segmentation', observed := coalesce(ceiling, 1)::double, passed := coalesce(ceiling, 1) >= 0.8), struct_pack(step := 2, test := 'retrieval', observed := in_top_20::int::double, passed := in_top_20),
    struct_pack(step := 3, test := 'context', observed := coalesce(coverage, 0)::double, passed := in_top_5 and coverage >= 0.8)], recursive := true) from {_CENTRE}, {_FIRST} where question_id = q"""
_WALK = f"select question_id, stage, step::bigint as step, test, round(observed, 6) as observed, passed, coalesce(count(*) filter (not passed) over (order by step rows between unbounded preceding and 1 preceding), 0) = 0 as read from ({_STEPS})"
_BANDOF = lambda c: f"case when {c} >= 0.85 then 'certain' when {c} >= 0.6 then 'probable' when {c} >= 0.35 then 'low' else 'insufficient' end"
_R20 = "select *, row_number() over (partition by question_id order by score desc, doc_id, chunk_no) as rnk from (select question_id, r.doc_id, r.chunk_no, round(case when len(q) > 0 then len(list_intersect(q, {c})) / len(q)::double else 0 end, 9) as score from {source} r join (select question_id, list_distinct({q}) as q from asked) using (question_id) join texts t on t.doc_id = r.doc_id and t.chunk_no = r.chunk_no where rnk <= {depth})"


def _traced(ranked: str, name: str) -> str:
    """in_top_5, coverage and mrr of a ranking."""
    return f"""select '{name}' as arm, a.question_id, coalesce(x.in5, false) as in_top_5, round(coalesce(v.coverage, 0), 6) as coverage, round(coalesce(1.0::double / g.gold_rank, 0), 6) as mrr from asked a
        left join (select *, row_number() over (partition by question_id order by f) as gold_rank from (select question_id, doc_id, min(rnk) as f from ({ranked}) where rnk <= 20 group by all)) g on g.question_id = a.question_id and g.doc_id = a.gold_doc
        left join (select r.question_id, bool_or(r.doc_id = q.gold_doc) as in5 from ({ranked}) r join asked q using (question_id) where rnk <= 5 group by 1) x on x.question_id = a.question_id
        left join (select question_id, sum(greatest(0, e - greatest(s, coalesce(seen, s)))) / max(gold_end - gold_start) as coverage from (select *, max(e) over (partition by question_id order by s, e rows between unbounded preceding and 1 preceding) as seen from
            (select r.question_id, gold_start, gold_end, greatest(char_start, gold_start) as s, least(char_end, gold_end) as e from ({ranked}) r join asked q using (question_id) join chunks c on c.doc_id = r.doc_id and c.chunk_no = r.chunk_no
             where rnk <= 5 and r.doc_id = q.gold_doc and char_end > gold_start and char_start < gold_end)) group by 1) v on v.question_id = a.question_id where a.answerable"""


_PUBLISHED = "(values ('bm25', 'recall_20', 0.7), ('bm25', 'coverage', 0.5618), ('bm25', 'mrr', 0.4736), ('bm25', 'ndcg_5', 0.4878), ('dense', 'recall_20', 0.8067), ('dense', 'coverage', 0.6307), ('dense', 'mrr', 0.5619), ('dense', 'ndcg_5', 0.5736)) p(configuration, metric, published)"
_HASHED = lambda key, text, rows: f"(select {key}, dim, c / sqrt(sum(c * c) over (partition by {key})) as x from (select {key}, {_hash('t')} % 64 as dim, count(*)::double as c from (select {key}, unnest({_tokens(text)}) as t from {rows}) group by all))"
_LIVE = "(select s.*, g.question from scored2 s join gen2 g using (configuration, question_id) where not abstained and trim(body) <> '')"

_FINAL |= {
    "dq_gold_spans": "select question_id, case when text is null then 'no document' when gold_end <= gold_start then 'empty span' else 'beyond the text' end as reason from asked left join documents on gold_doc = doc_id where answerable and (text is null or gold_end <= gold_start or gold_end > length(text))",
    "segmentation_agreement": f"""select method, count(*) as n_docs, round(avg(coalesce((x = y)::int, 0)), 6) as identical, round(avg(coalesce((len(x) = 1)::int, 0)), 6) as single, round(avg(coalesce((len(x) > 1)::int, 0)), 6) as several from
        (select method, doc_id, x, y from (select distinct method from {_AGREE}) cross join (select doc_id, list([char_start, char_end] order by char_start) as y from {_AGREE} where method = 'sliding_window' group by 1)
         left join (select method, doc_id, list([char_start, char_end] order by char_start) as x from {_AGREE} group by all) using (method, doc_id)) group by 1""",
    "segmentation_ceiling": f"select method, question_id, split, {_SIX('ceiling', 'best_single')}, n_hits, n_gold_chunks from {_CEILS}",
    "ceiling_summary": f"select method, split, count(*) as n, round(avg(ceiling), 6) as mean_ceiling, round(min(ceiling), 6) as min_ceiling, round(avg((ceiling < 0.8)::int), 6) as below from {_CEILS} group by all",
    "query_excerpt": _excerpt(r"regexp_extract_all(text, '\S+')", rf"list_transform(regexp_extract_all(text, '\S+'), lambda x: {_HIT.format('x')})", 20, " ", "array_to_string(w, ' ')"),
    "token_excerpt": _excerpt(r"regexp_extract_all(text, '\s*(?:\w+|[^\w\s])')", rf"flatten(list_transform(regexp_extract_all(text, '\S+'), lambda x: list_transform(regexp_extract_all(x, '\w+|[^\w\s]'), lambda z: {_HIT.format('x')})))", 24, "", "text"),
    "clipped_queries": r"select question_id, case when len(p) <= 8 then query else concat(array_to_string(p[1:8], ''), ' [...]') end as clipped from (select question_id, query, regexp_extract_all(query, '\s*(?:\w+|[^\w\s])') as p from asked)",
    "late_chunk_vectors": "select doc_id, chunk_no, dim, round(x, 6) as x from cv_late",
    "recursive_chunks": f"select * from {_line_chunks('documents', 64, 6)}",
    "recursive_chunks_plain": f"select * from {_plain_chunks('documents', 64, 6)}",
    "semantic_chunks": f"select * from {_semantic_chunks('documents', 64, 6)}",
    "nearest_vectors": """select query_id, vec_id, round(score, 6) as score, same_label, rnk from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rnk from
        (select q.vec_id as query_id, v.vec_id, q.label is not distinct from v.label as same_label, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 9) as score from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 10 = 0)) where rnk <= 5""",
    "reproduction": f"""select configuration, metric, published::double as published, round(ours, 6) as ours, round(ours - published, 6) as difference from {_PUBLISHED} join (select configuration, unnest([struct_pack(metric := 'recall_20', ours := avg(recall_20)), struct_pack(metric := 'coverage', ours := avg(coverage)),
        struct_pack(metric := 'mrr', ours := avg(mrr)), struct_pack(metric := 'ndcg_5', ours := avg(ndcg_5))], recursive := true) from traces where split = 'train' group by 1) using (configuration, metric)""",
    "sensitivity_arms": _traced(_R20.format(c=_content("text"), q=_content("query"), source="r_dense", depth=50), "depth 50") + " union all " + _traced(_R20.format(c=_content("text"), q=_content("query"), source="r_rrf", depth=20), "on hybrid"),
    "rerank_signals": """select question_id, round(max(score), 6) as rerank_top1, round(case when count(*) > 1 then max(score) filter (rnk = 1) - max(score) filter (rnk = 2) else 0 end, 6) as rerank_gap12, round(stddev_samp(score), 6) as rerank_std
        from r_reranked where rnk <= 5 group by 1""",
    "arm_means": _FINAL["arm_means"].replace("from traces", "from staged"),
    "arm_summary": _ci(_LONG, "configuration, metric", "question_id"),
    "answer_scores": _answers("recscored", "readrec", "conv_id, turn, split"),
    "generation_scores": _answers("scored2", "read2", "configuration, question_id, segment_ids"),
    "abstention_table": """select configuration, round(avg(abstained::int) filter (not answerable), 6) as abstention_on_unanswerable, round(1 - avg(abstained::int) filter (not answerable), 6) as false_answer_rate, round(avg(abstained::int) filter (answerable), 6) as abstention_on_answerable,
        round(avg(abstention_accuracy), 6) as abstention_accuracy, count(*) filter (not answerable) as n_unanswerable, count(*) filter (answerable) as n_answerable from scored2 group by 1""",
    "first_look": "select configuration, round(avg(1 - abstained::int), 6) as answered, round(avg(coalesce(token_f1 >= 0.15, false)::int), 6) as passes, round(avg(groundedness), 6) as groundedness from scored2 where answerable group by 1",
    "readability_summary": f"select string_split(doc, '|')[1] as configuration, count(*) as n, {', '.join(f'round(avg({c}), 6) as {c}' for c in _READS.split(', '))} from {_READ('read2').replace(', 6) as', ', 15) as')} group by 1",
    "answer_relevancy": f"""select configuration, question_id, case when l.question_id is not null then round(coalesce(c, 0), 6) end as relevancy from scored2 left join {_LIVE} l using (configuration, question_id) left join
        (select configuration, question_id, sum(q.x * a.x) as c from {_HASHED('configuration, question_id', 'question', _LIVE)} q join {_HASHED('configuration, question_id', 'body', _LIVE)} a using (configuration, question_id, dim) group by all) using (configuration, question_id)""",
    "copy_defects": """select question_id, count(distinct (in_top_20, in_top_5, coverage)) as "values", 3 as copies from (select * from traces where configuration = 'dense' union all select * from traces where configuration = 'dense_reranked') group by 1 having count(distinct (in_top_20, in_top_5, coverage)) > 1""",
    "stage_partition_ci": _ci(_STAGE_LONG, "configuration, stage", "question_id"),
    "threshold_sweep": _FINAL["threshold_sweep"].replace(" where configuration in ('bm25', 'dense')", ""),
    "dq_coverage_above_ceiling": "select configuration, question_id from staged where coverage > ceiling + 1e-4",
    "dq_trace_defects": _FINAL["dq_trace_defects"].replace("from traces", "from staged"),
    "sophistication_path": f"select (list_position(['bm25', 'dense', 'hybrid_rrf', 'dense_reranked'], configuration) - 1)::bigint as step, configuration, {_SHARES} from staged where configuration in ('bm25', 'dense', 'hybrid_rrf', 'dense_reranked') group by configuration",
    "stage_decomposition": f"""select t.configuration, t.stage, n, {_SIX('diff', 'lo', 'hi', 'p')}, round(p_holm, 6) as p_holm, moved, net_reachable, dominant from {_paired(_DELTA, 'configuration, stage', 'question_id')} t
        left join (select configuration, stage, p_holm from {_holm("(select * from " + _paired(_DELTA, 'configuration, stage', 'question_id') + " where stage <> 'R')", 'configuration', 'stage')}) h using (configuration, stage)
        join (select a.configuration, count(*) filter (a.stage <> b.stage) as moved, count(*) filter (a.stage = 'R') - count(*) filter (b.stage = 'R') as net_reachable from staged a join staged b using (question_id) where b.configuration = 'dense' and a.configuration <> 'dense' group by 1) using (configuration)
        left join (select configuration, arg_max(stage, (abs(diff), stage)) as dominant from {_holm("(select * from " + _paired(_DELTA, 'configuration, stage', 'question_id') + " where stage <> 'R')", 'configuration', 'stage')} where (lo > 0 or hi < 0) and p_holm < 0.05 group by 1) using (configuration)""",
    "generation_outcomes": "select * from outs2",
    "generation_summary": f"""select configuration, count(*) as n, {', '.join(f"round(avg((outcome = '{x}')::int), 6) as share_{x.lower()}" for x in ('S1', 'S2', 'S3', 'S4', 'OK'))}, count(*) filter (stage <> 'R' and correct) as correct_outside_reachable,
        round(avg(abstained::int) filter (outcome = 'S4'), 6) as s4_refusal_share, count(*) filter (was in ('OK', 'S4') and outcome not in ('OK', 'S4')) as lost_reach, count(*) filter (was = 'S4' and outcome not in ('OK', 'S4')) as lost_reach_s4
        from outs2 left join (select question_id, outcome as was from outs2 where configuration = 'dense') using (question_id) group by 1""",
    "outcome_contrasts": f"""select configuration, n, {_SIX('diff', 'lo', 'hi', 'p', 'dz')}, round(p_holm, 6) as p_holm, p_holm <= 0.05 as significant from
        {_holm(_paired("select a.configuration, a.question_id, a.correct::int::double - b.correct::int as x from outs2 a join outs2 b using (question_id) where b.configuration = 'dense' and a.configuration <> 'dense'", 'configuration', 'question_id'), '', 'configuration')}""",
    "outcomes_by_stage": "select configuration, stage, count(*) as n, round(avg(correct::int), 6) as correct, round(avg(abstained::int), 6) as abstained from outs2 group by all",
    "outcome_totals": """select count(distinct question_id) as questions, round(avg(abstained::int) filter (stage = 'R'), 6) as abstention_reachable, round(avg(abstained::int) filter (stage <> 'R'), 6) as abstention_blocked, round(avg(correct::int) filter (stage = 'R'), 6) as correct_reachable,
        round(avg(correct::int) filter (stage <> 'R'), 6) as correct_blocked, round(avg(abstained::int) filter (outcome = 'S4'), 6) as s4_refusal_share from outs2""",
    "prompt_comparison": f"""select grp, same_stage, n, {_SIX('correct_first', 'correct_second', 'abstained_first', 'abstained_second')}, round(c.diff, 6) as diff_correct, round(c.lo, 6) as lo_correct, round(c.hi, 6) as hi_correct, round(c.p, 6) as p_correct,
        round(a.diff, 6) as diff_abstained, round(a.lo, 6) as lo_abstained, round(a.hi, 6) as hi_abstained, round(a.p, 6) as p_abstained
        from (select grp, bool_and(stage_a = stage_b) as same_stage, avg(ca) as correct_first, avg(cb) as correct_second, avg(aa) as abstained_first, avg(ab) as abstained_second from {_GROUPS} group by 1)
        join {_paired(f"select grp, pair, cb - ca as x from {_GROUPS}", 'grp', 'pair')} c using (grp) join (select grp, diff, lo, hi, p from {_paired(f"select grp, pair, ab - aa as x from {_GROUPS}", 'grp', 'pair')}) a using (grp)""",
    "reviewed_outcomes": f"""select run::bigint as run, count(*) as n, {', '.join(f"count(*) filter (stage = '{x}') as n_{x.lower()}" for x in _STAGES)}, {', '.join(f"count(*) filter (label = '{x}') as {x}" for x in ('correct', 'partial', 'incorrect'))},
        {', '.join(f"count(*) filter (stage = '{x}' and label = '{y}') as {x.lower()}_{y}" for x in _STAGES for y in ('correct', 'partial', 'incorrect'))}, count(*) filter (stage <> 'R' and label = 'correct') as correct_outside_reachable,
        count(*) filter (stage <> 'R' and label = 'partial') as partial_outside_reachable, count(*) filter (stage = 'R' and label <> 'correct') as s4_strict, count(*) filter (stage = 'R' and label = 'incorrect') as s4_lenient
        from (select 1 as run, * from rev1 union all select 2, * from rev2) group by 1""",
    "reviewed_ablation": """select bool_and(a.question_id is not null and b.question_id is not null) as same_questions, bool_and(coalesce(a.segment_ids = b.segment_ids, false)) as identical_contexts,
        count(*) filter (a.stage = 'S1') = count(*) filter (b.stage = 'S1') and count(*) filter (a.stage = 'S2') = count(*) filter (b.stage = 'S2') and count(*) filter (a.stage = 'S3') = count(*) filter (b.stage = 'S3') and count(*) filter (a.stage = 'R') = count(*) filter (b.stage = 'R') as identical_partition,
        count(*) filter (b.label = 'correct') - count(*) filter (a.label = 'correct') as gain_correct, count(*) filter (b.label = 'correct' and b.stage = 'R') - count(*) filter (a.label = 'correct' and a.stage = 'R') as gain_inside_reachable,
        count(*) filter (b.label <> 'correct' and b.stage = 'R') - count(*) filter (a.label <> 'correct' and a.stage = 'R') as s4_strict_change from rev1 a full join rev2 b using (question_id)""",
    "reviewed_check": f"""select count(*) filter (stage <> 'R') as blocked, count(*) filter (stage <> 'R' and token_f1 >= 0.15) as blocked_passing, count(*) filter (stage <> 'R' and label = 'correct') as blocked_correct,
        {', '.join(f"count(*) filter (stage <> 'R' and token_f1 >= 0.15 and label = '{x}') as passing_{x}" for x in ('correct', 'partial', 'incorrect'))} from rev2""",
    "calibrate_threshold": """select threshold, round(bal, 6) as balanced_accuracy, round((tp + tn) / t, 6) as agreement, round(((tp + tn) / t - ch) / (1 - ch), 6) as kappa, round(fp / greatest(1, fp + tn), 6) as false_pass_rate, t::bigint as n, (tp + fn)::bigint as positives from
        (select *, round((tp / greatest(1, tp + fn) + tn / greatest(1, tn + fp)) / 2, 9) as bal, tp + fp + fn + tn as t, (tp + fp) / (tp + fp + fn + tn) * (tp + fn) / (tp + fp + fn + tn) + (fn + tn) / (tp + fp + fn + tn) * (tn + fp) / (tp + fp + fn + tn) as ch from
         (select threshold, count(*) filter (score >= threshold and y = 1)::double as tp, count(*) filter (score >= threshold and y <> 1)::double as fp, count(*) filter (score < threshold and y = 1)::double as fn, count(*) filter (score < threshold and y <> 1)::double as tn
          from lab, (select round(0.05::double + 0.005::double * i, 3) as threshold from range(70) r(i)) group by 1)) order by bal desc, round(abs(threshold - 0.15), 6), threshold limit 1""",
    "bootstrap_ci": _ci("select level, id, x from lev", "level"),
    "pairwise_baseline": f"select level, n, significant, {_SIX('diff', 'dz', 'hi', 'lo', 'p', 'p_holm')} from viewed",
    "described_contrasts": "select level, lo > 0 or hi < 0 as resolved, printf('%s: %+.3f [%+.3f, %+.3f], n = %d, %s', level, diff, lo, hi, n, case when lo > 0 or hi < 0 then 'resolved' else 'not resolved' end) as text from viewed",
    "matched_contrast": f"""select best, n, {_SIX('diff', 'lo', 'hi', 'p', 'dz')} from {_paired(f"select level as best, a.id, a.x - b.x as x from ({_FULL}) a join (select id, x from ({_FULL}) where level = 'view') b using (id) where level = (select arg_max(level, (m, level)) from (select level, avg(x) as m from ({_FULL}) where level <> 'view' group by 1))", 'best')}""",
    "repeated_measures": f"""select n_ids, n_levels, {_SIX('grand_mean', 'ss_level', 'ss_subject', 'ss_error', 'f', 'eta2', 'range', 'range_lo', 'range_hi', 'std_range', 'p')}, best, worst from {_EFFECT_P} join {_RANGE} using (factor, metric) where factor = 'type' and metric = 'mean'""",
    "main_effects": f"""select factor, metric, n_ids, n_levels, best, worst, significant, best_for_metric, matched_best, {_FIVE('grand_mean', 'ss_level', 'ss_subject', 'ss_error', 'f', 'eta2', 'range', 'range_lo', 'range_hi', 'std_range', 'p', 'p_holm', 'matched_diff', 'matched_lo', 'matched_hi', 'matched_p', 'matched_dz')} from effects""",
    "factor_ranking": f"select factor, {_FIVE('mean_statistic', 'median_statistic', 'mean_eta2', 'mean_range', 'mean_rank')}, metrics_won, n_metrics from ranking",
    "metric_winners": "select metric, factor, round(statistic, 5) as statistic from winners",
    "signed_contrasts": "select factor, round(avg(matched_diff * case metric when 'largest' then -1 else 1 end), 5) as mean_matched_diff, count(*) filter (matched_lo > 0 or matched_hi < 0) as resolved, count(*) as n_metrics from effects group by 1",
    "leading_factor": "select arg_max(factor, (mean_statistic, factor)) as factor, round(max(mean_statistic), 5) as mean_statistic, round(min(mean_statistic), 5) as next_statistic, (select count(*) from winners w where w.factor = (select arg_max(factor, (mean_statistic, factor)) from ranking)) as won, (select count(*) from winners) as metrics from ranking",
    "level_contrasts": f"""select metric, level, baseline, n, {_FIVE('diff', 'lo', 'hi', 'p', 'dz')} from {_paired("select metric, a.level, b.level as baseline, a.id, a.x - b.x as x from fac a join fac b using (factor, metric, id) where factor = 'type' and ((a.level = 'click' and b.level = 'view') or (a.level = 'purchase' and b.level = 'signup'))", 'metric, level, baseline')}""",
    "certainty_signals": f"select question_id, split, answerable, label_stage, {', '.join(f'round({c}, 5) as {c}' for c in [*_SIGNALS, 'label_evidence'])} from signals",
    "signal_audit": f"select signal, n, positives, {_FIVE('auroc', 'lo', 'hi')}, round(greatest(auroc, 1 - auroc), 5) as strength, case when auroc >= 0.5 then 1 else -1 end::bigint as direction, signal <> 'log_candidates' as used from {_areas(_SIGNAL_LONG, 'signal', 'question_id')}",
    "auroc_interval": f"select split, n, positives, {_SIX('auroc', 'lo', 'hi')} from {_areas('select split, doc_id, score as s, y from lab', 'split', 'doc_id')}",
    "certainty_bands": _FINAL["certainty_bands"].replace("'medium', 'high'", "'probable', 'certain'").replace("then 'high'", "then 'certain'").replace("then 'medium'", "then 'probable'"),
    "selective_answering": """select count(*) as n, round(avg((score < 0.35)::int), 6) as withheld_share, round(avg((score < 0.35)::int) filter (y <> 1), 6) as caught, round(avg((score < 0.35)::int) filter (y = 1), 6) as lost,
        round(avg(y) filter (score >= 0.35), 6) as rate_answered, round(avg(y), 6) as rate_all from lab""",
    "citation_bands": _FINAL["citation_bands"].replace(_abstains("answer"), f"{_abstains('answer')} or {_abstains(_BODY)}"),
    "citation_answers": "select question_id, configuration, answerable, round(token_f1, 6) as token_f1, n_cited, cites_top, abstained, band, correct from tested",
    "citation_correctness": "select configuration, band, count(t.correct) as n, round(avg(t.correct::int), 6) as correct from (select distinct configuration, unnest(['low', 'medium', 'high']) as band from tested where answerable) left join (select * from tested where answerable) t using (configuration, band) group by all",
    "citation_correctness_pooled": "select band, count(t.correct) as n, round(avg(t.correct::int), 6) as correct from (select unnest(['low', 'medium', 'high']) as band) left join (select * from tested where answerable) t using (band) group by all",
    "citation_high_minus_low": _high_low("configuration"),
    "citation_high_minus_low_pooled": _high_low(""),
    "citation_auroc": """select configuration, count(*) as n, sum(y)::bigint as positives, round(case when sum(y) > 0 and sum(y) < count(*) then (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) end, 6) as auroc from
        (select *, rank() over (partition by configuration order by s) + (count(*) over (partition by configuration, s) - 1) / 2.0::double as r from (select configuration, correct::int as y, case band when 'high' then 2 when 'medium' then 1 else 0 end as s from tested where answerable)) group by 1""",
    "citation_low_band": "select count(distinct question_id) as questions, count(*) as answers, round(avg((band = 'low')::int) filter (not answerable), 6) as unanswerable_low_band, round(avg((band = 'low')::int) filter (answerable), 6) as answerable_low_band from tested",
    "joint_bands": "select rband as retrieval_band, band as citation_band, count(*) as n, round(avg(correct::int), 6) as correct, round(avg((not answerable)::int), 6) as unanswerable from joint group by all",
    "joint_rule": """select round(avg(h::int), 6) as withheld_share, round(avg(correct::int) filter (not h), 6) as correct_if_kept, round(avg(correct::int), 6) as correct_all, round(count(*) filter (h and not answerable) / greatest(1, count(*) filter (not answerable)), 6) as unanswerable_caught,
        round(count(*) filter (h and correct) / greatest(1, count(*) filter (correct)), 6) as correct_lost from (select *, rband = 'insufficient' or band = 'low' as h from joint)""",
    "chunking_example": f"select question_id, method, round(coverage, 6) as coverage, round(ndcg_5, 6) as ndcg_5, in_top_5, method = (max((coverage, method)) over ())[2] as best, method = (min((coverage, method)) over ())[2] as worst from {_CONF}, {_WIDEST} where question_id = q",
    "retrieval_example": "select question_id, configuration, gold_rank, recall_20, round(coverage, 6) as coverage from traces where configuration in ('bm25', 'dense', 'hybrid_rrf', 'hybrid_weighted') and question_id = (select min(question_id) from traces)",
    "reranking_example": """select question_id, case configuration when 'dense' then 'off' else 'on' end as reranking, in_top_5, round(coverage, 6) as coverage, round(context_precision, 6) as context_precision from traces where configuration in ('dense', 'dense_reranked') and question_id =
        (select coalesce(min(question_id) filter (round(a.coverage, 9) <> round(b.coverage, 9)), min(question_id)) from traces a join traces b using (question_id) where a.configuration = 'dense' and b.configuration = 'dense_reranked')""",
    "effects_example": """select count(*) as n, round(avg(x), 6) as mean_centre, round(avg(y), 6) as mean_level, round(avg(d), 6) as mean_diff, count(*) filter (d < 0) as worse, count(*) filter (d = 0) as unchanged, count(*) filter (d > 0) as better, arg_min(question_id, (d, question_id)) as largest_loss, round(min(d), 6) as loss
        from (select question_id, a.coverage as x, b.coverage as y, round(b.coverage - a.coverage, 9) as d from traces a join traces b using (question_id) where a.configuration = 'dense' and b.configuration = 'bm25')""",
    "generation_example": f"select question_id, configuration, segment_ids, substr(answer, 1, 420) as answer, n_cited, {_SIX('groundedness', 'faithfulness', 'token_f1')}, abstained, coalesce(token_f1 >= 0.15, false) as passes from scored2 where configuration = 'dense' and answerable and question_id = (select min(question_id) from scored2 where configuration = 'dense' and answerable)",
    "attribution_example": _WALK,
    "attribution_scenario": f"select w.*, (select count(*) from {_CENTRE}) as questions, (select round(avg((stage = 'R')::int), 6) from {_CENTRE}) as reachable from ({_WALK}) w",
    "prompt_example": "select question_id, stage, abstained, correct, outcome from outs2 where configuration = 'dense' and question_id = (select min(question_id) from outs2 where configuration = 'dense')",
    "certainty_example": f"select question_id, {', '.join(f'round({c}, 5) as {c}' for c in [*_SIGNALS[:-1], 'label_evidence'])}, round(coalesce(dense_top1, 0), 5) as score, {_BANDOF('coalesce(dense_top1, 0)')} as band from signals where split = 'dev' and question_id = (select min(question_id) from signals where split = 'dev')",
    "citation_example": "select question_id, configuration, n_cited, cites_top, abstained, band, round(token_f1, 6) as token_f1, correct from tested where band = 'high' order by question_id, configuration limit 1",
    "segmentation_scenario": f"""select question_id, 'segmentation' as changed, method as level, gold_rank, round(coverage, 6) as coverage from {_CONF}, {_WIDEST} where question_id = q
        union all select question_id, 'retriever', configuration, gold_rank, round(coverage, 6) from traces, {_WIDEST} where question_id = q and configuration in ('bm25', 'dense', 'hybrid_rrf', 'hybrid_weighted')""",
    "certainty_scenario": f"""select e.e as "end", question_id, round(dense_top1, 5) as score, {_BANDOF('dense_top1')} as band, round(dense_z_top1, 5) as dense_z_top1, round(agree_top5, 5) as agree_top5, label_evidence from signals join
        (select 'lowest' as e, arg_min(question_id, (dense_top1, question_id)) as q from signals where split = 'dev' and dense_top1 is not null union all select 'highest', arg_max(question_id, (dense_top1, question_id)) from signals where split = 'dev' and dense_top1 is not null) e on q = question_id""",
}
_FINAL["citation_band_table"] = _FINAL["citation_band_table"].replace(_abstains("answer"), f"{_abstains('answer')} or {_abstains(_BODY)}")
del _FINAL["centre_identity"]


def _extracted(prompt: str, query: str) -> str:
    terms = f"list_filter(regexp_extract_all(lower({query}), '\\S+'), lambda w: length(w) > 3)"
    return f"coalesce(list_filter(list_transform(string_split(replace({prompt}, chr(10), ' '), '. '), lambda s: trim(s)), lambda s: list_has_any(regexp_extract_all(lower(s), '\\S+'), {terms}))[1], 'INSUFFICIENT EVIDENCE')"


_BASE["prompts"] = """select question_id, array_to_string(list(concat('[', doc_id, '::chunk_', chunk_no, ']', chr(10), array_to_string(regexp_extract_all(text, '\\S+')[1:greatest(64, 3200 // n)], ' ')) order by rnk), chr(10) || chr(10)) as prompt
    from (select r.*, t.text, count(*) over (partition by question_id) as n from r_bm25 r join texts t using (doc_id, chunk_no) where rnk <= 5) group by 1"""
_FINAL |= {
    "prompt_lengths": "select count(*) as n, round(quantile_cont(w, 0.5), 6) as median, round(quantile_cont(w, 0.95), 6) as p95, max(w) as longest from (select len(regexp_split_to_array(prompt, '\\s+')) as w from prompts)",
    "prompt_segments": r"select question_id, array_to_string(regexp_extract_all(prompt, '(?m)^\[([^\]]+::chunk_\d+)\]', 1), '|') as segments from prompts",
    "generated_answers": f"select question_id, {_extracted('prompt', 'query')} as answer from prompts join asked using (question_id)",
    "corpus_from_json": "select doc_id::varchar as doc_id, coalesce(array_to_string(string_split(text, ' ')[1:5], ' '), '') as title, md5(coalesce(text, '')) as digest, length(coalesce(text, '')) as n_chars from documents where doc_id is not null",
    "corpus_composition": "select split as part, count(*) as n from asked group by 1 union all select 'documents', count(*) from documents",
    "resumed_generation": f"select conv_id * 1000 + turn as question_id, split, {_extracted('answer', 'question')} as answer from recs",
}

ORACLES: dict[str, str] = {name: _sql(sql) for name, sql in _FINAL.items()}
