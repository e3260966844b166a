"""The operators' queries as SQL, where SQL can express them."""

OP1 = r"""
with d as (
    select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
    from documents
), i as (
    select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
    from benchmark
), ds as (
    select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s
    from d where len(w) >= 5
), its as (
    select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s
    from i where len(w) >= 5
), n as (select item_id, count(*) as n from its group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n) as n_shingles, count(*) / any_value(n) as containment
from its join ds using (s) join n using (item_id)
group by doc_id, item_id
having count(*) / any_value(n) >= 0.8
"""

OP8 = r"""
with w as (
    select doc_id, lang, source, text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from documents
), win as (
    select doc_id, unnest(range(1, len(w) - 3)) as p,
        unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s
    from w where len(w) >= 5
), twice as (
    select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, s) as c from win) where c >= 2
), rep as (
    select doc_id, sum(least(5, coalesce(next_p - p, 5))) as n_repeat_words
    from (select doc_id, p, lead(p) over (partition by doc_id order by p) as next_p from twice) group by doc_id
), m as (
    select w.doc_id, lang, source, len(w) as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '\p{Lu}', '', 'g')) as n_capitals,
        len(l) as n_lines
    from w left join rep using (doc_id)
), r as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
        n_symbols / greatest(word_chars, 1) as symbol_ratio,
        n_dup_lines / greatest(n_lines, 1) as duplicate_ratio,
        n_repeat_words / greatest(n_words, 1) as repeat_ratio,
        n_capitals / greatest(word_chars, 1) as capital_ratio,
        word_chars / greatest(n_words, 1) as word_length
    from m
), long as (
    select lang, source, ratio, value from (
        unpivot (select lang, source, symbol_ratio, duplicate_ratio, repeat_ratio, capital_ratio, word_length from r where not base_failed)
        on symbol_ratio, duplicate_ratio, repeat_ratio, capital_ratio, word_length into name ratio value value)
), q as (
    select lang, source, grouping(lang, source) as level, ratio, count(*) as n,
        quantile_disc(value, 0.25) as low, quantile_disc(value, 0.75) as high
    from long group by grouping sets ((lang, source, ratio), (lang, ratio), (ratio))
), slack as (
    select * from (values ('symbol_ratio', 0.04, false), ('duplicate_ratio', 0.3, false), ('repeat_ratio', 0.15, false),
        ('capital_ratio', 0.3, false), ('word_length', 3.0, true)) t(ratio, least_far, both_sides)
), f as (
    select q.*, case when both_sides then low - greatest(3.0 * (high - low), least_far::double) end as least,
        high + greatest(3.0 * (high - low), least_far::double) as most
    from q join slack using (ratio)
), v as (
    select r.doc_id, ratio, value,
        case when a.n >= 100 then a.least when b.n >= 100 then b.least else c.least end as least,
        case when a.n >= 100 then a.most when b.n >= 100 then b.most else c.most end as most
    from (select doc_id, lang, source, unnest(['symbol_ratio', 'duplicate_ratio', 'repeat_ratio', 'capital_ratio', 'word_length']) as ratio,
            unnest([symbol_ratio, duplicate_ratio, repeat_ratio, capital_ratio, word_length]) as value from r) r
    left join (select * from f where level = 0) a using (lang, source, ratio)
    left join (select * from f where level = 1) b using (lang, ratio)
    left join (select * from f where level = 3) c using (ratio)
), bad as (
    select doc_id, bool_or(coalesce(value > most, false) or coalesce(value < least, false)) as beyond from v group by doc_id
)
select r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not beyond as kept
from r join bad using (doc_id)
"""

OP12 = r"""
with p as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), w as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p
), g as materialized (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 5) t(k))
    group by all having count(*) >= 30
), n as (
    select lang, sum(len(w))::bigint as n from w group by lang
), cut as (
    select lang, k, phrase, f as a, j, string_split(phrase, ' ') as ws
    from (select *, unnest(range(1, k)) as j from g where k >= 2)
), lowest as (
    select * from (
        select cut.lang, cut.k, cut.phrase, a, l.f as l, r.f as r,
            ((2000000::hugeint * a) // (l.f + r.f))::bigint as score,
            row_number() over (partition by cut.lang, cut.phrase order by (2000000::hugeint * a) // (l.f + r.f), j) as place
        from cut
        join g l on l.lang = cut.lang and l.phrase = array_to_string(ws[1:j], ' ')
        join g r on r.lang = cut.lang and r.phrase = array_to_string(ws[j + 1:], ' ')
    ) where place = 1
), hidden as (
    select distinct s.lang, s.phrase
    from g s join g t on s.lang = t.lang and t.k > s.k and 100 * t.f >= 80 * s.f
        and contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')
    where s.k >= 2
), ranked as (
    select lowest.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
    from lowest anti join hidden using (lang, phrase)
)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


def op11_sql(k: int = 40, rounds: int = 5) -> str:
    """The clustering round by round: ``a`` has assignments, ``c`` centroids."""
    steps = [
        f"""
with kept as materialized (
    select row_number() over (order by vec_id) as id, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as p
    from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
    select row_number() over (order by sha256('2:' || vec_id), id) - 1 as c, p
    from kept order by sha256('2:' || vec_id), id limit {k}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f""", a{r} as materialized (
    select id, vec_id, c, d from (
        select id, vec_id, c, d, row_number() over (partition by id order by d, c) as place from (
            select id, vec_id, c,
                list_sum(list_transform(list_zip(kept.p, c{r}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
            from kept, c{r}
        )
    ) where place = 1
)"""
        )
        if r < rounds:
            steps.append(
                f""", m{r} as materialized (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as p
    from (select c, i, sum(p[i]) as s, count(*) as n from a{r} join kept using (id), range(1, 65) t(i) group by c, i)
    group by c
), c{r + 1} as materialized (
    select c, coalesce(m{r}.p, c{r}.p) as p from c{r} left join m{r} using (c)
)"""
            )
    return "".join(steps) + f"""
select vec_id, c::int as cluster, d as distance,
    (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
    sha256(array_to_string(p, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)
"""
