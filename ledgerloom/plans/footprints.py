"""SQL that reads the mapping files by itself, so that reports can be checked against the files' text."""

from __future__ import annotations

from ledgerloom.plans.mapping import HERE


def footprints(folder: str = str(HERE)) -> str:
    """A WITH clause of c (spoke, field, required, type, id): what each enabled format covers, by its file and its parents'."""
    value = lambda name: f"regexp_extract(body, '(?m)^{name} = \"([^\"]*)\"', 1)"
    return f"""WITH RECURSIVE tables AS (SELECT filename, unnest(string_split(chr(10) || content, chr(10) || '[')) AS body FROM read_text('{folder}/*.toml')),
    t AS (SELECT filename, regexp_extract(body, '^([^\\]\\n]+)\\]', 1) AS id, body, regexp_matches(body, '(?m)^disabled = true') AS off FROM tables WHERE regexp_matches(body, '^[^\\]\\n]+\\]')),
    meta AS (SELECT filename, {value("doc_format")} || ':' || {value("format_version")} AS spoke, {value("inherits")} AS parent, off FROM t WHERE id = 'meta'),
    chain AS (SELECT spoke, spoke AS at, 0 AS depth FROM meta WHERE NOT off UNION ALL SELECT chain.spoke, meta.parent, depth + 1 FROM chain JOIN meta ON meta.spoke = chain.at WHERE meta.parent <> ''),
    n AS (SELECT chain.spoke, id, {value("type")} AS type, {value("canonical_key")} AS key, regexp_matches(body, '(?m)^required = true') AS required
          FROM chain JOIN meta ON meta.spoke = chain.at JOIN t ON t.filename = meta.filename WHERE id <> 'meta'
          QUALIFY row_number() OVER (PARTITION BY chain.spoke, id ORDER BY depth) = 1),
    g AS (SELECT n.spoke, n.id, string_agg(o.key, '/' ORDER BY length(o.id)) AS around FROM n JOIN n AS o ON o.spoke = n.spoke AND o.type = 'collection' AND starts_with(n.id, o.id || '.') GROUP BY ALL),
    c AS (SELECT n.spoke, coalesce(around || '/', '') || key AS field, bool_or(required) AS required, min(type) AS type, min(n.id) AS id FROM n LEFT JOIN g USING (spoke, id) WHERE key <> '' GROUP BY 1, 2) """


#: After footprints(): r (source, target, state, missing, dropped) for all pairs of formats.
PAIRS = """, s AS (SELECT spoke, list(field ORDER BY field) AS has, coalesce(list(field ORDER BY field) FILTER (required), []) AS needs FROM c GROUP BY spoke),
    d AS (SELECT a.spoke AS source, b.spoke AS target, list_sort(list_filter(b.needs, lambda x: NOT list_contains(a.has, x))) AS missing,
                 list_sort(list_filter(a.has, lambda x: NOT list_contains(b.has, x))) AS dropped, len(b.needs) AS n_needs FROM s AS a, s AS b),
    r AS (SELECT *, CASE WHEN n_needs > 0 AND len(missing) = n_needs THEN 'error' WHEN len(missing) > 0 THEN 'partial' WHEN len(dropped) > 0 THEN 'lossful' ELSE 'lossless' END AS state FROM d) """
