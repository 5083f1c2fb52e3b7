"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from .secrets import BASE, RULES


def _secrets() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"""select blob, {rank} as rank, '{r.kind}' as kind, text,
                       regexp_extract_all(text, '{pattern}', 0) as m,
                       regexp_extract_all(text, '{pattern}', {r.group}) as v,
                       string_split_regex(text, '{pattern}') as g, {r.least} as least
                from blobs where regexp_matches(text, '{pattern}')"""
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank{}), '')"
    return f"""
        with blobs as (select distinct sha256(coalesce(text, '')) as blob, coalesce(text, '') as text from documents),
        hits as ({" union all ".join(parts)}),
        each as (select blob, rank, kind, least, m, v, g, unnest(range(1, len(m) + 1)) as i from hits),
        ends as (select blob, rank, kind, i, least, v[i] as value, length(m[i]) as size,
                        sum(length(g[i]) + length(m[i])) over (partition by blob, rank order by i) as e from each),
        spans as (select blob, rank, kind, e - size as s, e from ends where length(value) >= least),
        per as (select blob, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
                       count(*) filter (kind = 'hex') as n_hex,
                       {listed.format(", e")} as spans,
                       coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e) filter (kind in ({base})), '') as base
                from spans group by blob)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, b.blob
        from (select doc_id, sha256(coalesce(text, '')) as blob from documents) b left join per on per.blob = b.blob"""


_EXACT = r"""
    with n as (select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
           row_number() over w = 1 as kept, sha256(norm) as text_sha256
    from n window w as (partition by norm order by size desc, doc_id)"""

_WARC = """
    with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
    f as (select *, octet_length(payload) as n, min(page_id) over (partition by payload) as first from p)
    select page_id, n as payload_bytes, sha256(payload) as payload_digest,
           case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
           case when n >= 100 and first <> page_id then first end as refers_to
    from f"""

ORACLES = {"op2_secret_ledger": _secrets(), "op6_content_sort": _EXACT, "op10_warc_segments": _WARC}
