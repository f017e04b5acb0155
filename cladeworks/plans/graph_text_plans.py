"""Queries of groups E (graph) and F (text)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeworks.operators import graph as G
from cladeworks.operators import subwords as S
from cladeworks.operators import textetl as X
from cladeworks.operators.pairs import pair_table
from cladeworks.operators.sampling import hub_candidates as hubs
from cladeworks.operators.triplets import triplets
from cladeworks.plans.binding import CUSTOMER_TAX, PAIRS, customer_nodes, exclusions, supplier_nodes, table
from cladeworks.plans.triplet_plans import _TRIPLETS
from cladeworks.sources.stages import staged

ALLOWED = ["child", "sibling", "grandchild"]
ROUNDS = 20


def _child_edges(spark, sf):
    nodes = customer_nodes(spark, sf)
    edges = pair_table(nodes).where("relation = 'child'").select(F.col("idx_i").alias("src"), F.col("idx_j").alias("dst"))
    return staged(edges, "edges"), nodes.select(F.col("index").alias("id"), "level")


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def edge_index_weights(spark, sf):
    e = G.edge_index(pair_table(customer_nodes(spark, sf)), ALLOWED)
    return _rounded(e.groupBy("type", "weight").agg(F.count("*").alias("n"), F.sum(F.col("src").cast("long") * 3 + F.col("dst")).alias("checksum")))


def degree_centrality(spark, sf):
    edges, nodes = _child_edges(spark, sf)
    return _rounded(G.degree_centrality(G.mirrored(edges), nodes.select("id")), 9)


def pagerank(spark, sf):
    edges, nodes = _child_edges(spark, sf)
    return _rounded(G.pagerank(G.mirrored(edges), nodes.select("id"), rounds=ROUNDS, tolerance=None), 9)


def kcore(spark, sf):
    """Cores of the graph of suppliers linked with the next ones of their nation, and the next few of their balance bracket."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.floor(F.col("s_acctbal") / 250).alias("bracket"))
    edges = None
    for key, following in (("s_nationkey", 3), ("bracket", 2)):
        order = Window.partitionBy(key).orderBy("id")
        ahead = F.array_compact(F.array(*[F.lead("id", k).over(order) for k in range(1, following + 1)]))
        one = s.select(F.col("id").alias("src"), ahead.alias("ahead")).select("src", F.explode("ahead").alias("dst"))
        edges = one if edges is None else edges.unionByName(one)
    return G.kcore(G.mirrored(edges.distinct()), s.select("id"))


def node_composite(spark, sf):
    edges, nodes = _child_edges(spark, sf)
    return _rounded(G.node_scores(edges, nodes, ROUNDS, None), 8)


def hub_candidates(spark, sf):
    edges, nodes = _child_edges(spark, sf)
    both = G.mirrored(edges)
    scores = G.degree_centrality(both, nodes.select("id")).withColumnRenamed("degree", "composite")
    return _rounded(hubs(scores), 9)


def relation_cardinality(spark, sf):
    return _rounded(G.relation_cardinality(staged(pair_table(customer_nodes(spark, sf)), "pairs")))


def difficulty_thresholds(spark, sf):
    nodes = supplier_nodes(spark, sf)
    pairs = staged(pair_table(nodes, exclusions(nodes)), "pairs")
    return _rounded(G.difficulty_thresholds(pairs, triplets(pairs)))


# --- text

def _descriptions(spark, sf):
    return table(spark, sf, "documents").select((F.col("doc_id") + 100000).cast("string").alias("code"), F.col("text").alias("description"))


def _codes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.select((F.col("doc_id") + 100000).cast("string").alias("code")).unionByName(d.select((F.col("doc_id") % 10000).cast("string").alias("code"))).distinct()


def doc_blocks(spark, sf):
    return X.blocks(_descriptions(spark, sf), "\n").select("code", "description_id", F.length("description").alias("n"), F.md5("description").alias("digest"))


def doc_blocks_clean(spark, sf):
    clean = X.clean_blocks(X.blocks(_descriptions(spark, sf), "\n"))
    return clean.select("code", "description_id", F.md5("description").alias("digest"))


def doc_last_block(spark, sf):
    return X.last_blocks(X.blocks(_descriptions(spark, sf), "\n")).select("code", "description_id", F.md5("description").alias("digest"))


def doc_codes_extracted(spark, sf):
    found = X.blocks(_descriptions(spark, sf), "\n").select("code", "description_id", F.posexplode(X.mentioned_codes(F.col("description"))).alias("nth", "digit"))
    return found


def doc_code_lists(spark, sf):
    """Every document as a cross-reference text: mentioned codes that are codes themselves."""
    clean = X.clean_blocks(X.blocks(_descriptions(spark, sf), "\n"))
    cross = _descriptions(spark, sf).select("code", F.lit(0).alias("ord"), F.col("description").alias("excluded"))
    excl, _ = X.exclusions(cross, clean, _codes(spark, sf))
    return excl.select("level", "code", F.length("excluded").alias("n_chars"), F.array_join("excluded_codes", ",").alias("excluded_codes"))


def doc_examples_merge(spark, sf):
    """Labels as the example sheet, blocks behind a document's first as the extracted examples."""
    raw = X.blocks(_descriptions(spark, sf), "\n")
    marked = raw.withColumn("description", F.when(F.col("description_id") == 2, F.lit(X.EXAMPLES_MARK)).otherwise(F.col("description")))
    sheet = table(spark, sf, "labels").select((F.col("doc_id") + 100000).cast("string").alias("code"), F.lit(0).alias("ord"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("examples"))
    merged, starts = X.examples(sheet, marked, X.clean_blocks(marked), _codes(spark, sf))
    return merged.join(starts, "code", "full_outer").select("code", F.md5("examples").alias("digest"), F.col("description_id_min").alias("first_example"))


def _numbered_blocks(spark, sf):
    """Documents as one-block descriptions of four-, five- and six-digit codes; every third one is empty."""
    k = F.col("doc_id") % 8
    head = (F.floor(F.col("doc_id") / 8) + 1000).cast("string")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", "1", "2", "3", "9", "10", "20", "90")]), (k + 1).cast("int"))
    text = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("This industry "), F.col("text")))
    return table(spark, sf, "documents").select(F.concat(head, tail).alias("code"), F.lit(1).alias("description_id"), text.alias("description"), "doc_id")


def doc_fill_missing(spark, sf):
    """Beyond 72,000 documents some share a code (10001 is 1000 and 1, and 10001 and nothing): each is a record of its own."""
    rows = _numbered_blocks(spark, sf)
    none = rows.where("doc_id % 16 = 1").select("code", "doc_id", "description_id")
    starts = rows.where("doc_id % 16 = 2").select("code", "doc_id", F.lit(1).alias("description_id_min"))
    return X.filled(rows, none, starts, "doc_id").select("code", F.md5("description").alias("digest"))


def channel_tokens(spark, sf):
    """Source and text of every document in windows of 512 tokens."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("description"))
    t = X.channel_tokens(d, {"title": 512, "description": 512})
    return t.select("doc_id", "window", F.array_join("title_tokens", "|").alias("title"), F.md5(F.array_join("description_tokens", "|")).alias("digest"), F.aggregate("description_mask", F.lit(0), lambda s, x: s + x).alias("n"))


# A small vocabulary: characters, and some endings and beginnings of words, at the front of words and inside of them; signs only as words.
_PARTS = [*"abcdefghijklmnopqrstuvwxyz0123456789", *"er en in the ch ung st tion al an on or re es ti nd th ion ing ver der sch heit keit lich que ent aire des".split()]
_SIGNS = list(".,;:!?-()|@+/%=")
TITLE, BODY = 8, 256


def subword_tokens(spark, sf):
    """Source and whole text of every document as sub-word ids in windows of 8 and 256 places."""
    vocab = S.vocabulary(spark, [*_PARTS, *_SIGNS, *[S.INSIDE + p for p in _PARTS]])
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("body"))
    t = S.encoded(d, "doc_id", {"title": TITLE, "body": BODY}, vocab)
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return t.select("doc_id", "window", ids("title_ids").alias("title"), F.md5(ids("body_ids")).alias("digest"), F.aggregate("body_mask", F.lit(0), lambda s, x: s + x).alias("n"))


def html_strip(spark, sf):
    p = table(spark, sf, "pages").select("page_id", X.html_stripped(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_index_weights, degree_centrality, pagerank, kcore, node_composite, hub_candidates, relation_cardinality, difficulty_thresholds,
        doc_blocks, doc_blocks_clean, doc_last_block, doc_codes_extracted, doc_code_lists, doc_examples_merge, doc_fill_missing, channel_tokens, subword_tokens, html_strip,
    )
}

_CHILD = f"{CUSTOMER_TAX}, {PAIRS}, ce AS (SELECT idx_i AS s, idx_j AS d FROM pairs WHERE relation_id = 1), me AS (SELECT s, d FROM ce UNION ALL SELECT d, s FROM ce), outd AS (SELECT s, count(*) AS o FROM me GROUP BY 1), nn AS (SELECT count(*) AS n FROM nodes)"
_DEGREE = 'deg AS (SELECT "index" AS id, level, coalesce(o, 0) / CAST(n - 1 AS DOUBLE) AS degree FROM nodes LEFT JOIN outd ON s = "index", nn)'


def _rank_steps(n):
    steps = ['r0 AS MATERIALIZED (SELECT "index" AS id, 1.0::DOUBLE / n AS r FROM nodes, nn)']
    for i in range(1, n + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT a.id, 0.15::DOUBLE / n + 0.85 * coalesce(g, 0) AS r FROM r{i - 1} a LEFT JOIN (SELECT me.d AS id, sum(r / o) AS g FROM me JOIN r{i - 1} p ON p.id = me.s JOIN outd ON outd.s = me.s GROUP BY 1) q ON q.id = a.id, nn)")
    return ", ".join(steps)


_RANKED = f"{_rank_steps(ROUNDS)}, pr AS (SELECT id, r / (SELECT sum(r) FROM r{ROUNDS}) AS rank FROM r{ROUNDS})"
_BLOCKS = r"""src AS (SELECT CAST(doc_id + 100000 AS VARCHAR) AS code, text AS description FROM documents),
parts AS (SELECT code, [x FOR x IN string_split(description, chr(10)) IF length(x) > 0] AS p FROM src),
raw AS (SELECT code, CAST(description_id AS INTEGER) AS description_id, description FROM (SELECT code, unnest(p) AS description, unnest(range(1, len(p) + 1)) AS description_id FROM parts)
  WHERE description <> 'The Sector as a Whole' AND NOT regexp_matches(description, 'Cross-References.'))"""


def _clean_sql(c):
    unpad = lambda x: f"regexp_replace(regexp_replace({x}, '^ ', ''), ' $', '')"
    c = f"replace({unpad(c)}, 'NULL', '')"
    for pattern, to in ((r"See industry description for \d{6}\.", ""), ("<.*?>", ""), (r"\x{00A0}", " ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    for old, new in ((".", ". "), ("U. S. ", "U.S."), ("e. g. ,", "e.g.,"), ("i. e. ,", "i.e.,"), (";", "; "), ("31-33", "31"), ("44-45", "44"), ("48-49", "48")):
        c = f"replace({c}, '{old}', '{new}')"
    return unpad(rf"regexp_replace({c}, '\s{{2,}}', ' ', 'g')")


_KNOWN = "known AS (SELECT CAST(doc_id + 100000 AS VARCHAR) AS code FROM documents UNION SELECT CAST(doc_id % 10000 AS VARCHAR) FROM documents)"

def _subword_sql():
    quoted = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
    parts = "|".join(sorted(_PARTS, key=len, reverse=True))
    first, signs = len(S.SPECIAL), len(_PARTS)
    words = r"""regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x60\x7B-\x7E]')"""
    window = lambda n: f"[2] || ids[k * {n - 2} + 1:k * {n - 2} + {n - 2}] || [3]"
    padded = lambda n, x: f"array_to_string(list_resize({x}, {n}, 0), ',')"
    return f"""WITH t AS (SELECT doc_id, 0 AS c, source AS t FROM documents UNION ALL SELECT doc_id, 1, text FROM documents),
      w AS MATERIALIZED (SELECT doc_id, c, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (SELECT doc_id, c, {words} AS ws FROM t)),
      cut AS (SELECT word, regexp_extract_all(word, '{parts}') AS p FROM (SELECT DISTINCT word FROM w)),
      known AS MATERIALIZED (SELECT word, CASE WHEN list_position({quoted(_SIGNS)}, word) > 0 THEN [CAST({first + signs - 1} + list_position({quoted(_SIGNS)}, word) AS INTEGER)]
        WHEN length(array_to_string(p, '')) = length(word) AND length(word) <= 100 THEN list_transform(p, lambda x, i: CAST(CASE WHEN i = 1 THEN {first - 1} ELSE {first + signs + len(_SIGNS) - 1} END + list_position({quoted(_PARTS)}, x) AS INTEGER))
        ELSE [1] END AS ids FROM cut),
      body AS (SELECT doc_id, c, flatten(list(ids ORDER BY place)) AS ids FROM w JOIN known USING (word) GROUP BY 1, 2),
      whole AS (SELECT doc_id, c, CASE WHEN t IS NULL OR t = '' THEN [4] ELSE coalesce(ids, CAST([] AS INTEGER[])) END AS ids FROM t LEFT JOIN body USING (doc_id, c)),
      k AS (SELECT doc_id, c, ids, unnest(range(greatest(CAST(ceil(len(ids) / CASE c WHEN 0 THEN {TITLE - 2}.0 ELSE {BODY - 2}.0 END) AS INTEGER), 1))) AS k FROM whole),
      a AS (SELECT doc_id, k, {window(TITLE)} AS x FROM k WHERE c = 0), b AS (SELECT doc_id, k, {window(BODY)} AS x FROM k WHERE c = 1)
      SELECT doc_id, CAST(k AS INTEGER) AS "window", {padded(TITLE, "coalesce(a.x, CAST([] AS INTEGER[]))")} AS title, md5({padded(BODY, "coalesce(b.x, CAST([] AS INTEGER[]))")}) AS digest,
        CAST(coalesce(len(b.x), 0) AS INTEGER) AS n FROM a FULL JOIN b USING (doc_id, k)"""


SQL = {
    "edge_index_weights": f"""WITH {CUSTOMER_TAX}, {PAIRS}, k AS (SELECT * FROM pairs WHERE relation IN ('child', 'sibling', 'grandchild')), t AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS type FROM (SELECT DISTINCT relation FROM k)),
      o AS (SELECT idx_i AS s, idx_j AS d, type, greatest(0.05, 1.0 / (1 + 0.2 * greatest(0, relation_id - 1))) AS w FROM k JOIN t USING (relation)), nd AS (SELECT s FROM o UNION SELECT d FROM o),
      e AS (SELECT * FROM o UNION ALL SELECT d, s, type, w FROM o UNION ALL SELECT s, s, (SELECT count(*) FROM t), 1.0 FROM nd)
      SELECT CAST(type AS INTEGER) AS type, round(CAST(w AS DOUBLE), 6) AS weight, count(*) AS n, CAST(sum(CAST(s AS BIGINT) * 3 + d) AS BIGINT) AS checksum FROM e GROUP BY 1, 2""",
    "degree_centrality": f"WITH {_CHILD}, {_DEGREE} SELECT id, round(degree, 9) AS degree FROM deg",
    "pagerank": f"WITH {_CHILD}, {_RANKED} SELECT id, round(rank, 9) AS rank FROM pr",
    # in a tree with an edge every core number is 1
    "node_composite": f"""WITH {_CHILD}, {_DEGREE}, {_RANKED}, j AS (SELECT deg.id, level, degree, rank FROM deg JOIN pr USING (id)), m AS (SELECT min(degree) AS ld, max(degree) AS hd, min(rank) AS lr, max(rank) AS hr FROM j)
      SELECT id, level, round(degree, 8) AS degree, round(rank, 8) AS pagerank, CAST(1 AS BIGINT) AS kcore, round(0.4 * (degree - ld) / (hd - ld) + 0.4 * (rank - lr) / (hr - lr), 8) AS composite FROM j, m""",
    "hub_candidates": f"WITH {_CHILD}, {_DEGREE} SELECT id, round(degree, 9) AS composite FROM deg WHERE degree >= (SELECT quantile_cont(degree, 0.8) FROM deg)",
    "relation_cardinality": f"""WITH {CUSTOMER_TAX}, {PAIRS}, t AS (SELECT relation, avg(n) AS tph FROM (SELECT relation, idx_i, count(DISTINCT idx_j) AS n FROM pairs GROUP BY 1, 2) GROUP BY 1),
      h AS (SELECT relation, avg(n) AS hpt FROM (SELECT relation, idx_j, count(DISTINCT idx_i) AS n FROM pairs GROUP BY 1, 2) GROUP BY 1), e AS (SELECT relation, relation_id, count(*) AS n FROM pairs GROUP BY 1, 2)
      SELECT relation, relation_id, round(tph, 6) AS tails_per_head, round(hpt, 6) AS heads_per_tail, n AS num_edges, CASE WHEN hpt > 1.5 THEN 'N' ELSE '1' END || '-' || CASE WHEN tph > 1.5 THEN 'N' ELSE '1' END AS cardinality,
      CASE WHEN relation_id <= 1 THEN 'easy' WHEN relation_id <= 4 THEN 'medium' ELSE 'hard' END AS difficulty_tier FROM e JOIN t USING (relation) JOIN h USING (relation)""",
    "difficulty_thresholds": f"""WITH {_TRIPLETS}, d AS (SELECT quantile_cont(distance, [0.2, 0.6, 0.9]) AS p, min(distance) AS lo, max(distance) AS hi, avg(distance) AS m, stddev_pop(distance) AS s FROM xpairs),
      g AS (SELECT quantile_cont(margin, [0.8, 0.4, 0.1]) AS p, min(margin) AS lo, max(margin) AS hi, avg(margin) AS m, stddev_pop(margin) AS s FROM trip)
      SELECT round(d.p[1], 6) AS phase1_max_distance, round(d.p[2], 6) AS phase2_max_distance, round(d.p[3], 6) AS phase3_max_distance, round(d.hi, 6) AS phase4_max_distance,
      round(g.p[1], 6) AS phase1_min_margin, round(g.p[2], 6) AS phase2_min_margin, round(g.p[3], 6) AS phase3_min_margin, 0.0::DOUBLE AS phase4_min_margin,
      1 AS phase1_max_relation, 4 AS phase2_max_relation, 10 AS phase3_max_relation, 99 AS phase4_max_relation,
      round(d.lo, 6) AS distance_min, round(d.m, 6) AS distance_mean, round(d.s, 6) AS distance_std, round(g.lo, 6) AS margin_min, round(g.hi, 6) AS margin_max, round(g.m, 6) AS margin_mean, round(g.s, 6) AS margin_std FROM d, g""",
    "doc_blocks": f"WITH {_BLOCKS} SELECT code, description_id, CAST(length(description) AS INTEGER) AS n, md5(description) AS digest FROM raw",
    "doc_blocks_clean": f"WITH {_BLOCKS} SELECT code, description_id, md5({_clean_sql('description')}) AS digest FROM raw",
    "doc_last_block": f"WITH {_BLOCKS} SELECT code, description_id, md5(description) AS digest FROM raw QUALIFY description_id = max(description_id) OVER (PARTITION BY code)",
    "doc_codes_extracted": rf"""WITH {_BLOCKS}, m AS (SELECT code, description_id, regexp_extract_all(description, ' \d{{2,6}}') AS m FROM raw)
      SELECT code, description_id, CAST(nth AS INTEGER) AS nth, substr(d, 2) AS digit FROM (SELECT code, description_id, unnest(m) AS d, unnest(range(0, len(m))) AS nth FROM m)""",
    "doc_code_lists": rf"""WITH {_BLOCKS}, {_KNOWN}, clean AS (SELECT code, description_id, {_clean_sql('description')} AS description FROM raw),
      a AS (SELECT code, 0 AS origin, 1 AS id, description FROM src WHERE regexp_matches(description, ' \d{{2,6}}')
        UNION ALL SELECT code, 1, description_id, description FROM (SELECT * FROM clean QUALIFY description_id = max(description_id) OVER (PARTITION BY code))
          WHERE regexp_matches(description, '[Ee]xclude') AND regexp_matches(description, ' \d{{2,6}}')),
      m AS (SELECT DISTINCT code, origin, id, description, substr(unnest(regexp_extract_all(description, ' \d{{2,6}}')), 2) AS digit FROM a)
      SELECT CAST(length(m.code) AS INTEGER) AS level, m.code, CAST(length(string_agg(description, ' ' ORDER BY origin, id, digit)) AS INTEGER) AS n_chars, string_agg(digit, ',' ORDER BY origin, id, digit) AS excluded_codes
      FROM m WHERE digit IN (SELECT code FROM known) GROUP BY m.code""",
    "doc_examples_merge": f"""WITH {_BLOCKS}, marked AS (SELECT code, description_id, CASE WHEN description_id = 2 THEN 'Illustrative Examples:' ELSE description END AS description FROM raw),
      mark AS (SELECT code, description_id AS mark FROM marked WHERE contains(description, 'Illustrative Examples:')),
      e2 AS (SELECT code, string_agg({_clean_sql('description')}, '; ' ORDER BY description_id) AS e, min(description_id) AS lo FROM marked JOIN mark USING (code) WHERE mark < description_id GROUP BY 1),
      e1 AS (SELECT CAST(doc_id + 100000 AS VARCHAR) AS code, 'quality ' || CAST(quality AS VARCHAR) AS e FROM labels)
      SELECT code, md5(coalesce(e1.e, e2.e)) AS digest, lo AS first_example FROM e1 FULL OUTER JOIN e2 USING (code)""",
    "doc_fill_missing": """WITH n AS (SELECT doc_id, CAST(1000 + doc_id // 8 AS VARCHAR) || ['', '1', '2', '3', '9', '10', '20', '90'][doc_id % 8 + 1] AS code, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'This industry ' || text END AS t FROM documents),
      k AS (SELECT code, t FROM n WHERE doc_id % 16 NOT IN (1, 2)), w AS (SELECT * FROM k WHERE t <> ''),
      f AS (SELECT k.code, replace(substr(w.t, 1, 14), 'This industry', 'This NAICS industry') || substr(w.t, 15) AS t FROM k JOIN w ON w.code = k.code || '0' WHERE length(k.code) = 5 AND k.t = ''),
      a AS (SELECT * FROM w UNION ALL SELECT * FROM f),
      o AS (SELECT k.code, arg_min(a.t, s) AS t FROM k, (VALUES (1), (2), (3), (4), (9)) v(s) JOIN a ON a.code = k.code || CAST(s AS VARCHAR) WHERE length(k.code) = 4 AND k.t = '' GROUP BY 1)
      SELECT code, md5(t) AS digest FROM a UNION ALL SELECT code, md5(CASE WHEN starts_with(t, 'This NAICS industry') THEN 'This industry group' || substr(t, 20) ELSE 'This industry group' || substr(t, 14) END) FROM o""",
    "subword_tokens": _subword_sql(),
    "channel_tokens": r"""WITH d AS (SELECT doc_id, coalesce(nullif(source, ''), '[EMPTY]') AS s, CASE WHEN doc_id % 5 = 0 THEN '[EMPTY]' ELSE coalesce(nullif(text, ''), '[EMPTY]') END AS t FROM documents),
      a AS (SELECT doc_id, regexp_split_to_array(s, '\s+') AS s, regexp_split_to_array(t, '\s+') AS t FROM d),
      k AS (SELECT doc_id, s, t, unnest(range(0, greatest((len(s) - 1) // 512, (len(t) - 1) // 512) + 1)) AS k FROM a),
      w AS (SELECT doc_id, k, s[k * 512 + 1:k * 512 + 512] AS s, t[k * 512 + 1:k * 512 + 512] AS t FROM k)
      SELECT doc_id, CAST(k AS INTEGER) AS "window", array_to_string(s, '|') || repeat('|', 512 - greatest(len(s), 1)) AS title,
        md5(array_to_string(t, '|') || repeat('|', 512 - greatest(len(t), 1))) AS digest, CAST(len(t) AS INTEGER) AS n FROM w""",
    "html_strip": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS t FROM pages),
      b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM a) SELECT page_id, CAST(length(t) AS INTEGER) AS n, md5(t) AS digest FROM b""",
}
