"""Digestion over the line blocks of the documents and the lines of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, view
from foliant.operators import digestion as dg
from foliant.plans.session import staged

LIMIT = 1000
FAN = 4

# Headings are every sixth line, two of three below the one before; later lines go back to the first heading or
# name a line that is no heading. Some documents have a parent that is no heading or comes later.
_ID = "concat(CAST(doc_id AS STRING), ':', CAST({n} AS STRING))"
_FIRST = "(doc_id % 2 * 3)"
_PLAN = f"""SELECT doc_id AS document_id, block_no AS reading_order, {_ID.format(n="block_no")} AS block_id,
  CASE WHEN block_no % 6 = {_FIRST} THEN 'heading' WHEN block_no % 17 = 9 THEN 'table' ELSE 'text' END AS kind,
  CASE WHEN block_no % 6 = {_FIRST} THEN CASE WHEN doc_id % 23 = 4 AND block_no = 12 THEN {_ID.format(n=1)} WHEN doc_id % 29 = 6 AND block_no = 6 THEN {_ID.format(n=12)}
      WHEN (block_no - {_FIRST}) % 18 <> 0 THEN {_ID.format(n="block_no - 6")} END
    WHEN block_no % 13 = 7 THEN {_ID.format(n=_FIRST)} WHEN block_no % 17 = 5 THEN {_ID.format(n=1)} END AS parent_id,
  length(trim(text)) > 0 AND (doc_id + block_no) % 31 <> 2 AS eligible, text, start, {{end}} FROM {{blocks}}"""
view("plan_blocks", _PLAN.replace("{end}", "`end`"), _PLAN.replace("{end}", '"end"'))

HEADS = """hd AS (SELECT document_id, block_id, reading_order FROM {plan_blocks} WHERE kind = 'heading'),
pb AS (SELECT p.*, h.reading_order AS parent_order FROM {plan_blocks} p LEFT JOIN hd h ON h.document_id = p.document_id AND h.block_id = p.parent_id),
bad AS (SELECT DISTINCT document_id FROM pb WHERE (kind = 'heading' AND parent_id IS NOT NULL AND parent_order IS NULL) OR parent_order >= reading_order)"""
STRUCT = f"""{HEADS},
mk AS (SELECT *, CASE WHEN kind = 'heading' THEN block_id WHEN parent_order IS NOT NULL THEN parent_id END AS marker FROM pb WHERE document_id NOT IN (FROM bad)),
ow AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY reading_order), 'fallback') AS owner FROM mk),
tn AS (SELECT *, CASE WHEN owner <> lag(owner) OVER (PARTITION BY document_id ORDER BY reading_order) THEN 1 ELSE 0 END AS turn FROM ow),
st AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY document_id ORDER BY reading_order) AS BIGINT) AS island FROM tn)"""


@query("structure_assign", f"WITH {STRUCT} SELECT block_id, owner FROM st")
def structure_assign(t):
    return dg.structure(t.plan_blocks.drop("text")).select("block_id", "owner")


@query("planning_failures", f"WITH {HEADS} SELECT document_id, 'structural_planning_failed' AS reason FROM bad")
def planning_failures(t):
    return dg.planning_failures(t.plan_blocks)


@query("owner_islands", f"""WITH {STRUCT} SELECT document_id, island, any_value(owner) AS owner, min(reading_order) AS first_block, count(*) AS blocks
FROM st GROUP BY document_id, island""")
def owner_islands(t):
    return dg.structure(t.plan_blocks.drop("text")).groupBy("document_id", "island").agg(
        F.min_by("owner", "reading_order").alias("owner"),
        F.min("reading_order").alias("first_block"),
        F.count(F.lit(1)).alias("blocks"),
    )


FEW = "least(4, (4500 - coalesce(pa.chars, 0)) // 1500)"
UNITS = f"""{STRUCT},
ln AS (SELECT document_id, block_id AS unit, block_id AS above, parent_id AS up, length(text) AS chars, 1 AS depth FROM mk WHERE kind = 'heading'
  UNION ALL SELECT l.document_id, l.unit, h.block_id, h.parent_id, l.chars + 1 + length(h.text), l.depth + 1 FROM ln l JOIN mk h ON h.document_id = l.document_id AND h.block_id = l.up),
un AS (SELECT document_id, block_id AS unit, coalesce(parent_id, 'root') AS parent, CASE WHEN parent_id IS NULL THEN 'section' ELSE 'subsection' END AS kind FROM mk WHERE kind = 'heading'
  UNION ALL SELECT DISTINCT document_id, 'fallback', 'root', 'fallback' FROM mk UNION ALL SELECT DISTINCT document_id, 'root', NULL, 'document' FROM mk),
pa AS (SELECT document_id, unit, max(depth) AS depth, max(chars) AS chars FROM ln GROUP BY document_id, unit),
fu AS (SELECT un.*, CAST(coalesce(pa.depth, 0) AS INT) AS depth, coalesce(pa.chars, 0) AS path_chars, {FEW} AS fan FROM un LEFT JOIN pa USING (document_id, unit))"""


@query("section_units", f"WITH RECURSIVE {UNITS} SELECT document_id, unit, parent, kind, depth, path_chars FROM fu")
def section_units(t):
    titled = t.plan_blocks.withColumn("text", F.when(F.col("kind") == "heading", F.col("text")))
    units = dg.section_units(dg.structure(titled))
    path = F.length(F.array_join("path", "/")).alias("path_chars")
    return units.select("document_id", "unit", "parent", "kind", F.size("path").alias("depth"), path)


def _plan(t):
    """Units (with the lengths of the headings on their paths) and chunks. The text is read once, where blocks are cut and measured, and not moved."""
    blocks = staged(dg.piece_spans(t.plan_blocks.withColumn("chars", F.length("text")), LIMIT), "blocks")
    units = staged(dg.section_units(blocks, label=F.coalesce("chars", F.lit(0))), "sections")
    placed = dg.structure(blocks.drop("chars"), units=units).where("eligible")
    pieces = placed.select("document_id", "island", "owner", "block_id", "reading_order", F.inline("spans"))
    return units, staged(dg.pack_chunks(pieces, LIMIT), "chunks")


PACK = f"""{UNITS},
pc AS (SELECT document_id, island, owner, kind, block_id, start + n * {LIMIT} AS start, least({LIMIT}, length(text) - n * {LIMIT}) AS size, length(text) <= {LIMIT} AS whole,
  row_number() OVER (PARTITION BY document_id ORDER BY reading_order, n) AS rn
  FROM (SELECT *, unnest(range(0, (length(text) + {LIMIT - 1}) // {LIMIT})) AS n FROM st WHERE eligible)),
pk AS (SELECT document_id, rn, island, size AS held, 0 AS sequence FROM pc WHERE rn = 1
  UNION ALL SELECT p.document_id, p.rn, p.island, CASE WHEN p.island <> k.island OR k.held + p.size > {LIMIT} THEN p.size ELSE k.held + p.size END,
    k.sequence + CASE WHEN p.island <> k.island OR k.held + p.size > {LIMIT} THEN 1 ELSE 0 END
  FROM pk k JOIN pc p ON p.document_id = k.document_id AND p.rn = k.rn + 1),
ch AS (SELECT pc.*, pk.sequence, CASE WHEN kind = 'table' THEN 'visual_uninterpreted' WHEN whole THEN 'none' ELSE 'hard_split' END AS limitation FROM pc JOIN pk USING (document_id, rn))"""


@query("pack_chunks", f"""WITH RECURSIVE {PACK} SELECT document_id, block_id, start, size, sequence, sequence - min(sequence) OVER (PARTITION BY document_id, island) AS position, limitation FROM ch""")
def pack_chunks(t):
    return _plan(t)[1].select(
        "document_id", "block_id", "start", (F.col("end") - F.col("start")).alias("size"), "sequence", "position", "limitation"
    )


TREE = f"""{PACK},
lf AS (SELECT DISTINCT document_id, owner AS unit, sequence FROM ch),
up AS (SELECT DISTINCT document_id, unit, above FROM ln UNION SELECT document_id, unit, 'root' FROM un UNION SELECT document_id, 'fallback', 'fallback' FROM un),
lo AS (SELECT lf.document_id, up.above AS unit, min(sequence) AS "at" FROM lf JOIN up USING (document_id, unit) GROUP BY ALL),
rf AS (SELECT document_id, unit FROM lo JOIN fu USING (document_id, unit) WHERE fan < 2),
cg AS (SELECT * FROM ch WHERE document_id NOT IN (SELECT document_id FROM rf)),
kn AS (SELECT document_id, unit, "at", sub FROM (SELECT document_id, unit, sequence AS "at", CAST(NULL AS VARCHAR) AS sub FROM lf UNION ALL SELECT fu.document_id, fu.parent, lo."at", fu.unit FROM fu JOIN lo USING (document_id, unit) WHERE fu.parent IS NOT NULL)
  WHERE document_id NOT IN (SELECT document_id FROM rf)),
po AS (SELECT *, row_number() OVER (PARTITION BY document_id, unit ORDER BY "at") - 1 AS place FROM kn),
nd AS (SELECT document_id, unit, count(*) AS n, fan, 1 AS round FROM po JOIN fu USING (document_id, unit) GROUP BY ALL
  UNION ALL SELECT document_id, unit, (n + fan - 1) // fan, fan, round + 1 FROM nd WHERE n > fan),
tp AS (SELECT document_id, unit, max(round) AS rounds FROM nd GROUP BY ALL),
rg AS (SELECT *, unnest(range(0, n)) AS c FROM nd),
ed AS (SELECT rg.document_id, rg.unit, rg.round, c // fan AS position, CASE WHEN rg.round > 1 THEN rg.unit || '/' || (rg.round - 1) || '/' || c
    WHEN po.sub IS NULL THEN 'chunk-' || po."at" ELSE po.sub || '/' || sb.rounds || '/0' END AS child, rg.round = tp.rounds AS top
  FROM rg JOIN tp USING (document_id, unit) LEFT JOIN po ON po.document_id = rg.document_id AND po.unit = rg.unit AND po.place = rg.c
  LEFT JOIN tp sb ON sb.document_id = rg.document_id AND sb.unit = po.sub)"""


def _refusable(t, context: int = 6500):
    """Chunks by unit, units, and the children a unit's reducer has room for."""
    units, chunks = _plan(t)
    path = F.aggregate("path", F.lit(0), lambda a, n: a + n + 1)  # with a mark between two headings
    fan = dg.fan_in(F.lit(4), F.lit(context), F.lit(1000), F.greatest(path - 1, F.lit(0)) + 1000, F.lit(1500))
    return chunks, chunks.select("document_id", F.col("owner").alias("unit"), "sequence"), units, fan


def _tree(t):
    """The chunks and reducers of the plans that are not refused."""
    chunks, owned, units, fan = _refusable(t)
    edges = staged(dg.reduction_tree(owned, units, fan), "edges")
    return chunks.join(edges.select("document_id").distinct(), "document_id", "left_semi"), edges


@query("refused_units", f"WITH RECURSIVE {TREE} SELECT document_id, unit, 'synthesis_limit_exceeded' AS reason FROM rf")
def refused_units(t):
    _, owned, units, fan = _refusable(t)
    return dg.refused_units(owned, units, fan)


@query("reduction_tree", f"WITH RECURSIVE {TREE} SELECT * FROM ed")
def reduction_tree(t):
    return _tree(t)[1]


@query("stage_kind", f"""WITH RECURSIVE {TREE}
SELECT document_id, child AS stage, 'chunk' AS stage_kind FROM ed WHERE child LIKE 'chunk-%'
UNION ALL SELECT DISTINCT document_id, unit || '/' || round || '/' || position, CASE WHEN NOT top THEN 'intermediate' WHEN unit = 'root' THEN 'root' ELSE 'structural' END FROM ed""")
def stage_kind(t):
    return dg.stage_kind(_tree(t)[1])


# Claims are made of all chunks: with more room, and room for two children at least, no plan is refused.
ROOMY = TREE.replace(FEW, "greatest(2, least(4, (7000 - coalesce(pa.chars, 0)) // 1500))")


@query("synth_claims", f"""WITH RECURSIVE {ROOMY}
SELECT document_id, 'chunk-' || sequence AS stage_id, 'fact' AS kind, count(*) AS links, coalesce(string_agg(DISTINCT CASE WHEN limitation <> 'none' THEN limitation END, ',' ORDER BY CASE WHEN limitation <> 'none' THEN limitation END), '') AS limitations FROM cg GROUP BY document_id, sequence
UNION ALL SELECT document_id, unit || '/' || round || '/' || position, 'commentary', count(*), '' FROM ed GROUP BY document_id, unit, round, position""")
def synth_claims(t):
    chunks, owned, units, fan = _refusable(t, 9000)
    edges = staged(dg.reduction_tree(owned, units, F.greatest(F.lit(2), fan)), "edges")
    pieces = chunks.select("document_id", F.concat(F.lit("chunk-"), F.col("sequence").cast("string")).alias("chunk"), "limitation")
    reducer = F.concat_ws("/", "unit", F.col("round").cast("string"), F.col("position").cast("string"))
    return dg.synth_claims(pieces, edges.select("document_id", reducer.alias("reducer"), "child"))


# ---- trees and claim graphs over the blocks as leaves ----------------------------------

view("leaves", "SELECT doc_id AS document_id, block_no AS position FROM {blocks}")
LV = f"""lv AS (SELECT document_id, count(*) AS n, 0 AS l FROM {{leaves}} GROUP BY ALL UNION ALL SELECT document_id, (n + {FAN - 1}) // {FAN}, l + 1 FROM lv WHERE n > 1 OR l = 0)"""


@query("claim_reach", f"""WITH RECURSIVE {LV},
e AS (SELECT document_id, (l + 1) || ':' || (c // {FAN}) AS src, l || ':' || c AS dst FROM (SELECT *, unnest(range(0, n)) AS c FROM lv WHERE n > 1 OR l = 0)
  WHERE NOT (l = 1 AND (document_id + c) % 7 = 0)),
r AS (SELECT document_id, max(l) || ':0' AS node FROM lv GROUP BY document_id UNION SELECT r.document_id, e.dst FROM r JOIN e ON e.document_id = r.document_id AND e.src = r.node)
SELECT * FROM r""")
def claim_reach(t):
    edges = dg.reduction_edges(t.leaves, ["document_id"], FAN)
    node = lambda level, place: F.concat_ws(":", level.cast("string"), place.cast("string"))
    kept = edges.where(~((F.col("level") == 2) & ((F.col("document_id") + F.col("child")) % 7 == 0)))
    lineage = kept.select(
        "document_id",
        node(F.col("level"), F.col("position")).alias("src"),
        node(F.col("level") - 1, F.col("child")).alias("dst"),
    )
    roots = edges.where("top").select("document_id", node(F.col("level"), F.col("position")).alias("node")).distinct()
    return dg.claim_reach(lineage, roots).drop("depth")


def _stages(t):
    """Chunks and reducers of the reduction tree with what each holds itself; some chunks could not be analyzed."""
    chunks, edges = _tree(t)
    named = edges.withColumn("stage", F.concat_ws("/", "unit", F.col("round").cast("string"), F.col("position").cast("string")))
    key = F.col("document_id") + F.col("sequence")
    leaf = chunks.groupBy("document_id", "sequence").agg(F.count("*").alias("links")).select(
        "document_id", F.concat(F.lit("chunk-"), F.col("sequence").cast("string")).alias("stage"), "sequence",
        F.when(key % 9 == 0, "unavailable").otherwise("analyzed").alias("outcome"), "links",
        F.when(F.col("sequence") % 3 == 1, F.concat(F.lit("q"), F.col("sequence").cast("string"))).alias("q"), (F.col("sequence") % 5 == 0).alias("asks"),
        F.concat(F.lit("s"), (F.col("sequence") % 4).cast("string")).alias("subject"),
        F.when(key % 3 == 0, "affirmed").when(key % 3 == 1, "denied").otherwise("unknown").alias("stance"),
    )
    inner = named.groupBy("document_id", "stage", "unit", "round", "position").agg(F.count("*").alias("links"), F.bool_or("top").alias("top")).select(
        "document_id", "stage", F.lit(None).cast("bigint").alias("sequence"), F.lit("analyzed").alias("outcome"), "links",
        F.when(F.col("position") % 2 == 1, F.concat(F.lit("r"), "stage")).alias("q"), (F.col("round") == 2).alias("asks"),
        F.concat(F.lit("s"), (F.col("position") % 4).cast("string")).alias("subject"),
        F.when(F.col("round") % 2 == 0, "denied").otherwise("unknown").alias("stance"), "unit", "top",
    )
    return chunks, staged(named, "reducers"), staged(leaf.unionByName(inner, allowMissingColumns=True), "stages")


STAGES = f"""{TREE},
rd AS (SELECT document_id, unit || '/' || round || '/' || position AS stage, unit, round, position, bool_or(top) AS top, count(*) AS links FROM ed GROUP BY ALL),
sg AS (SELECT document_id, 'chunk-' || sequence AS stage, sequence, CASE WHEN (document_id + sequence) % 9 = 0 THEN 'unavailable' ELSE 'analyzed' END AS outcome, count(*) AS links,
  CASE WHEN sequence % 3 = 1 THEN 'q' || sequence END AS q, sequence % 5 = 0 AS asks, 's' || sequence % 4 AS subject,
  CASE (document_id + sequence) % 3 WHEN 0 THEN 'affirmed' WHEN 1 THEN 'denied' ELSE 'unknown' END AS stance, CAST(NULL AS VARCHAR) AS unit, false AS top FROM cg GROUP BY document_id, sequence
  UNION ALL SELECT document_id, stage, NULL, 'analyzed', links, CASE WHEN position % 2 = 1 THEN 'r' || stage END, round = 2, 's' || position % 4, CASE WHEN round % 2 = 0 THEN 'denied' ELSE 'unknown' END, unit, top FROM rd)"""


@query("inherited_counts", f"""WITH RECURSIVE {STAGES},
an AS (SELECT document_id, stage AS below, stage FROM sg UNION ALL SELECT an.document_id, an.below, e.unit || '/' || e.round || '/' || e.position FROM an JOIN ed e ON e.document_id = an.document_id AND e.child = an.stage),
al AS (SELECT an.stage AS node, s.* FROM an JOIN sg s ON s.document_id = an.document_id AND s.stage = an.below),
cn AS (SELECT document_id, node, count(*) FILTER (y AND n) AS contradictions FROM (SELECT document_id, node, subject, bool_or(stance = 'affirmed') AS y, bool_or(stance = 'denied') AS n FROM al GROUP BY ALL) GROUP BY ALL)
SELECT document_id, node AS stage, CAST(coalesce(sum(links) FILTER (sequence IS NOT NULL AND outcome = 'analyzed'), 0) AS BIGINT) AS analyzed, CAST(coalesce(sum(links) FILTER (outcome = 'unavailable'), 0) AS BIGINT) AS failed,
  count(q) AS qualifications, count(*) FILTER (asks) AS questions, any_value(contradictions) AS contradictions FROM al JOIN cn USING (document_id, node) GROUP BY ALL""")
def inherited_counts(t):
    _, edges, stages = _stages(t)
    own = stages.select(
        "document_id", "stage", F.when(F.col("sequence").isNotNull() & (F.col("outcome") == "analyzed"), F.col("links")).otherwise(0).alias("analyzed"),
        F.when(F.col("outcome") == "unavailable", F.col("links")).otherwise(0).alias("failed"), F.col("q").isNotNull().cast("int").alias("qualifications"), F.col("asks").cast("int").alias("questions"),
    )
    return dg.inherited_counts(edges.select("document_id", "stage", "child"), own, stages.select("document_id", "stage", "subject", "stance"), ["analyzed", "failed", "qualifications", "questions"])


view(
    "tree_nodes",
    """SELECT job_id AS document_id, unit AS node, CASE WHEN unit = 1 THEN CASE WHEN job_id % 17 = 3 THEN 2 END WHEN job_id % 19 = 4 AND unit = 3 THEN CAST(NULL AS INT)
         WHEN job_id % 23 = 6 AND unit = 5 THEN 4 WHEN job_id % 23 = 6 AND unit = 4 THEN 5 ELSE 1 END AS parent, unit AS rank_in FROM {steps}""",
)
view(
    "tree_rows",
    """SELECT document_id, node, parent, CASE WHEN document_id % 29 = 8 AND node = 2 THEN 9 ELSE CAST(row_number() OVER (PARTITION BY document_id, parent ORDER BY node) - 1 AS INT) END AS ord FROM {tree_nodes}""",
)


@query("tree_validity", """WITH RECURSIVE f AS (SELECT document_id, node FROM {tree_rows} WHERE parent IS NULL
  UNION SELECT t.document_id, t.node FROM f JOIN {tree_rows} t ON t.document_id = f.document_id AND t.parent = f.node),
s AS (SELECT document_id, bool_or(lo <> 0 OR hi <> n - 1 OR k <> n) AS disorder FROM (SELECT document_id, parent, count(*) AS n, min(ord) AS lo, max(ord) AS hi, count(DISTINCT ord) AS k
  FROM {tree_rows} WHERE parent IS NOT NULL GROUP BY ALL) GROUP BY ALL),
o AS (SELECT DISTINCT c.document_id FROM {tree_rows} c WHERE c.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tree_rows} p WHERE p.document_id = c.document_id AND p.node = c.parent)),
l AS (SELECT DISTINCT document_id FROM {tree_rows} t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.document_id = t.document_id AND f.node = t.node)),
r AS (SELECT document_id, count(*) FILTER (parent IS NULL) AS roots FROM {tree_rows} GROUP BY ALL)
SELECT document_id, CASE WHEN roots <> 1 THEN 'root_count' WHEN document_id IN (SELECT * FROM o) THEN 'orphan' WHEN document_id IN (SELECT * FROM l) THEN 'cycle'
  WHEN coalesce(disorder, false) THEN 'child_order' ELSE 'valid' END AS verdict FROM r LEFT JOIN s USING (document_id)""")
def tree_validity(t):
    return dg.tree_validity(t.tree_rows)


# ---- claims, coverage, digests ---------------------------------------------------------

view(
    "stage_claims",
    """SELECT job_id AS stage_id, unit AS position, job_id * 10 + unit + CASE WHEN worker % 23 = 1 THEN 1 ELSE 0 END AS claim_id, job_id * 10 + unit AS expected_id,
         job_id + CASE WHEN worker % 29 = 2 THEN 1 ELSE 0 END AS origin, CASE WHEN unit % 3 = 0 THEN 'commentary' ELSE 'fact' END AS kind,
         CASE WHEN worker % 31 = 3 THEN 'unknown' ELSE 'supported' END AS status, CASE WHEN quantity % 2 = 0 THEN 'subject' END AS subject, quantity * 10 AS chars FROM {steps}""",
)
view(
    "claim_evidence",
    """SELECT job_id AS stage_id, unit AS position, worker % 5 AS evidence_id, quantity % 7 = 0 AS contradicting FROM {steps} WHERE worker % 6 <> 0
       UNION ALL SELECT job_id, unit, quantity % 11, quantity % 7 <> 1 AND worker % 3 = 0 FROM {steps} WHERE worker % 4 = 1""",
)
view(
    "claim_qualifications",
    """SELECT job_id AS stage_id, unit AS position, CAST(0 AS INT) AS number, quantity * 11 AS chars, CASE WHEN worker % 3 <> 0 THEN worker % 5 END AS evidence_id FROM {steps} WHERE worker % 8 = 3
       UNION ALL SELECT job_id, unit, CAST(1 AS INT), quantity, worker % 5 FROM {steps} WHERE worker % 8 = 3 AND quantity % 2 = 0
       UNION ALL SELECT job_id, unit, CAST(1 AS INT), quantity, quantity % 5 FROM {steps} WHERE worker % 8 = 3 AND quantity % 6 = 0
       UNION ALL SELECT job_id, unit, CAST(2 AS INT), quantity, worker % 5 FROM {steps} WHERE worker % 16 = 3""",
)
view(
    "stage_results",
    """SELECT job_id AS stage_id, CASE WHEN job_id % 3 = 0 THEN 'reduction' ELSE 'analysis' END AS stage, job_id + CASE WHEN job_id % 41 = 7 THEN 1 ELSE 0 END AS result_id,
         CASE WHEN (job_id % 3 = 0) <> (job_id % 43 = 8) THEN 'reduction' ELSE 'analysis' END AS result_kind,
         CASE WHEN scope % 13 = 4 THEN 'unavailable' ELSE 'analyzed' END AS outcome, job_id % 100 AS characters, CASE WHEN scope % 5 = 1 THEN 0 ELSE job_id % 9 END AS claims,
         scope % 7 AS questions, scope % 3 AS limitations FROM {jobs}""",
)
view(
    "stage_allowed",
    """SELECT job_id AS stage_id, worker % 5 AS evidence_id FROM {steps} UNION ALL SELECT job_id, quantity % 11 FROM {steps} WHERE quantity % 13 <> 2""",
)
view(
    "claim_lineage",
    """SELECT job_id AS stage_id, unit AS position, quantity % 4 AS child FROM {steps} WHERE unit % 2 = 0 UNION ALL SELECT job_id, unit, worker % 4 FROM {steps} WHERE worker % 9 = 4""",
)
view(
    "stage_links",
    """SELECT job_id AS stage_id, quantity % 4 AS child, min(worker) % 3 <> 0 AS has_source FROM {steps} WHERE worker % 11 <> 3 GROUP BY job_id, quantity % 4""",
)


@query("stage_validation", """SELECT stage_id, CASE WHEN characters > 95 THEN 'canonical_response_limit' WHEN result_id <> stage_id THEN 'stage_id_mismatch' WHEN result_kind <> stage THEN 'stage_kind_mismatch'
  WHEN outcome = 'unavailable' THEN CASE WHEN stage <> 'analysis' THEN 'unavailable_reduction' WHEN claims > 0 THEN 'unavailable_with_claims' WHEN limitations = 0 THEN 'unavailable_missing_limitation'
    WHEN greatest(questions, limitations) > 5 THEN 'annotation_limit' END
  WHEN stage = 'analysis' AND claims = 0 THEN 'analyzed_without_claims' WHEN claims > 7 THEN 'claim_limit' WHEN greatest(questions, limitations) > 5 THEN 'annotation_limit' END AS reason FROM {stage_results}""")
def stage_validation(t):
    return dg.validate_stages(t.stage_results, max_characters=95, max_claims=7, max_annotations=5)


@query("claim_validation", """WITH e AS (SELECT stage_id, position, contradicting, count(*) AS cited, bool_or(times > 1) AS dup, bool_or(NOT known) AS alien FROM (
  SELECT c.*, count(*) OVER (PARTITION BY c.stage_id, c.position, c.contradicting, c.evidence_id) AS times,
    EXISTS (SELECT 1 FROM {stage_allowed} a WHERE a.stage_id = c.stage_id AND a.evidence_id = c.evidence_id) AS known FROM {claim_evidence} c) GROUP BY ALL),
l AS (SELECT stage_id, position, bool_or(times > 1) AS dup, bool_or(has_source IS NULL) AS bad, bool_or(has_source) AS inherits FROM (
  SELECT c.*, count(*) OVER (PARTITION BY c.stage_id, c.position, c.child) AS times, k.has_source FROM {claim_lineage} c LEFT JOIN {stage_links} k USING (stage_id, child)) GROUP BY ALL),
q AS (SELECT stage_id, position, number, list(evidence_id) FILTER (evidence_id IS NOT NULL) AS ids, any_value(chars) AS chars FROM {claim_qualifications} GROUP BY ALL),
qv AS (SELECT stage_id, position, number, CASE WHEN ids IS NULL THEN 'invalid_qualification_source' WHEN chars > 480 THEN 'text_limit' WHEN len(ids) <> len(list_distinct(ids))
  OR NOT list_has_all((SELECT list(a.evidence_id) FROM {stage_allowed} a WHERE a.stage_id = q.stage_id), ids) THEN 'invalid_qualification_source' END AS v FROM q),
qq AS (SELECT stage_id, position, count(*) AS n, arg_min(v, number) FILTER (v IS NOT NULL) AS v FROM qv GROUP BY ALL)
SELECT c.stage_id, c.position, c.claim_id, CASE WHEN EXISTS (SELECT 1 FROM {stage_claims} p WHERE p.stage_id = c.stage_id AND p.claim_id = c.claim_id AND p.position < c.position) THEN 'duplicate_claim_id'
  WHEN claim_id <> expected_id THEN 'claim_id_mismatch' WHEN origin <> c.stage_id THEN 'originating_stage_mismatch' WHEN c.chars > 480 THEN 'text_limit' WHEN qq.n > 2 THEN 'annotation_limit'
  WHEN e.dup THEN 'duplicate_evidence' WHEN e.alien THEN 'foreign_evidence' WHEN x.dup THEN 'duplicate_evidence' WHEN x.alien THEN 'foreign_evidence' WHEN l.dup THEN 'duplicate_child_link' WHEN l.bad THEN 'invalid_child_link'
  WHEN kind = 'fact' AND (NOT (coalesce(e.cited, 0) > 0 OR coalesce(inherits, false)) OR status <> 'supported') THEN 'unsupported_fact' WHEN qq.v IS NOT NULL THEN qq.v
  WHEN subject IS NOT NULL AND kind <> 'fact' THEN 'subject_on_nonfact' END AS reason
FROM {stage_claims} c LEFT JOIN (SELECT * FROM e WHERE NOT contradicting) e USING (stage_id, position) LEFT JOIN (SELECT * FROM e WHERE contradicting) x USING (stage_id, position)
  LEFT JOIN l USING (stage_id, position) LEFT JOIN qq USING (stage_id, position)""")
def claim_validation(t):
    t.hold("steps", "job_id", "unit", "worker", "quantity")
    return dg.validate_claims(
        t.stage_claims, t.claim_evidence, t.stage_allowed, t.claim_lineage, t.stage_links, t.claim_qualifications, max_text=480, max_annotations=2
    )


@query("coverage_missing", """SELECT DISTINCT stage_id, 'missing_source_coverage' AS reason, CAST(evidence_id AS VARCHAR) AS item FROM {stage_allowed} a
  WHERE stage_id IN (SELECT stage_id FROM {stage_results} WHERE stage = 'analysis' AND outcome = 'analyzed') AND (stage_id, evidence_id) NOT IN (SELECT (stage_id, evidence_id) FROM {claim_evidence})
UNION ALL SELECT stage_id, 'missing_child_coverage', CAST(child AS VARCHAR) FROM {stage_links}
  WHERE stage_id IN (SELECT stage_id FROM {stage_results} WHERE stage = 'reduction') AND (stage_id, child) NOT IN (SELECT (stage_id, child) FROM {claim_lineage})""")
def coverage_missing(t):
    return dg.missing_coverage(t.stage_results, t.stage_allowed, t.claim_evidence, t.stage_links, t.claim_lineage)


_CLASSED = """SELECT doc_id AS document_id, concat(CAST(doc_id AS STRING), ':', CAST(block_no AS STRING)) AS block_id, block_no, start, {end}, text,
  CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'native_text' END AS status, CASE WHEN (doc_id + block_no) % 31 = 0 THEN 'manual_review' ELSE 'native_accepted' END AS outcome,
  CASE WHEN block_no % 11 = 4 THEN ' ' ELSE text END AS seen_text FROM {blocks}"""
view("source_units", _CLASSED.replace("{end}", "`end`"), _CLASSED.replace("{end}", '"end"'))
CLASS = "CASE WHEN status = 'failed' OR outcome <> 'native_accepted' THEN 'unsupported' WHEN trim(seen_text) = '' THEN 'skipped' ELSE 'eligible' END"


@query("source_classes", f"""SELECT document_id, {CLASS} AS source_class, count(*) AS units FROM {{source_units}} GROUP BY ALL""")
def source_classes(t):
    units = t.source_units.select("document_id", "status", "outcome", F.col("seen_text").alias("text"))
    return dg.source_classes(units).groupBy("document_id", "source_class").agg(F.count(F.lit(1)).alias("units"))


# Analyzed intervals: 200-character steps that overlap by 20; some are lost.
@query("coverage", f"""WITH p AS (SELECT document_id, block_id, start + n * 200 AS s, least("end", start + n * 200 + 220) AS e, start AS b_start, "end" AS b_end FROM (
  SELECT *, unnest(range(0, (length(text) + 199) // 200)) AS n FROM {{source_units}}) WHERE (document_id + block_no * 3 + n) % 37 <> 0),
g AS (SELECT *, max(e) OVER (PARTITION BY block_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM p),
f AS (SELECT block_id, bool_and(s <= coalesce(reached, b_start)) AND max(e) = max(b_end) AS ok FROM g GROUP BY block_id),
d AS (SELECT document_id, count(*) FILTER (c = 'eligible') AS eligible, count(*) FILTER (c = 'eligible' AND ok) AS included, count(*) FILTER (c = 'eligible' AND NOT ok) AS failed,
  count(*) FILTER (c = 'skipped') AS skipped, count(*) FILTER (c = 'unsupported') AS unsupported FROM (SELECT u.document_id, {CLASS} AS c, coalesce(ok, false) AS ok FROM {{source_units}} u LEFT JOIN f USING (block_id)) GROUP BY ALL),
x AS (SELECT *, CASE WHEN eligible + unsupported > 0 THEN included / (eligible + unsupported) ELSE 0.0 END AS fr FROM d)
SELECT * EXCLUDE (fr), round(fr, 6) AS fraction, CASE WHEN fr < 0.8 THEN 'FAILED' WHEN failed = 0 AND unsupported = 0 THEN 'COMPLETE' WHEN included > 0 AND failed <= 2 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM x""")
def coverage(t):
    units = t.source_units
    steps = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 200).cast("int"))
    pieces = units.select("*", F.explode(steps).alias("n")).where(
        (F.col("document_id") + F.col("block_no") * 3 + F.col("n")) % 37 != 0
    )
    begin = F.col("start") + F.col("n") * 200
    intervals = pieces.select(
        "document_id", "block_id", begin.alias("start"), F.least(F.col("end"), begin + 220).alias("end")
    )
    blocks = dg.source_classes(units.withColumn("text", F.col("seen_text")))
    out = dg.coverage(
        blocks, intervals, minimum=0.8, allow_partial=True, max_failed=2
    )
    return out.withColumn("fraction", F.round("fraction", 6))


view(
    "stance_claims",
    """SELECT l_suppkey % 20 AS document_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_extendedprice AS STRING)) AS claim_id,
         CASE WHEN l_quantity > 3 THEN concat('part:', CAST(l_partkey AS STRING)) END AS subject, CASE l_returnflag WHEN 'A' THEN 'affirmed' WHEN 'R' THEN 'denied' ELSE 'unknown' END AS stance,
         concat('claim on ', CAST(l_partkey AS STRING)) AS text, CAST(l_quantity AS BIGINT) % 3 AS qualifications, l_suppkey FROM {lineitem}""",
)
CONFLICT = """sd AS (SELECT * FROM {stance_claims} WHERE subject IS NOT NULL AND stance IN ('affirmed', 'denied')),
cf AS (SELECT * FROM sd WHERE (document_id, subject) IN (SELECT (document_id, subject) FROM sd GROUP BY document_id, subject HAVING count(DISTINCT stance) = 2))"""


@query("contradictions", f"WITH {CONFLICT} SELECT document_id, subject, stance, claim_id FROM cf")
def contradictions(t):
    return dg.contradictions(t.stance_claims, ["document_id"])


view("digest_notes", "SELECT l_orderkey AS document_id, CASE WHEN l_returnflag = 'R' THEN 'question' ELSE 'limitation' END AS kind, concat('note ', CAST(l_suppkey % 5 AS STRING)) AS text FROM {lineitem} WHERE l_returnflag <> 'N'")


_DIGEST_STATE = "CASE WHEN document_id % 4 < 2 THEN 'COMPLETE' WHEN document_id % 4 = 2 THEN 'PARTIAL' ELSE 'FAILED' END"


@query("digest_rollup", f"""WITH RECURSIVE {STAGES},
cl AS (SELECT *, stage || ':c' AS claim_id, CASE WHEN sequence IS NULL THEN 'commentary ' ELSE 'fact ' END || links AS text FROM sg WHERE outcome = 'analyzed'),
lg AS (SELECT document_id, unit || '/' || round || '/' || position || ':c' AS src, child || ':c' AS dst FROM ed WHERE (document_id + length(child)) % 37 <> 5
    AND coalesce((document_id + TRY_CAST(substr(child, 7) AS BIGINT)) % 9 <> 0 OR child NOT LIKE 'chunk-%', true)
  UNION ALL SELECT document_id, stage || ':c', 'ghost' FROM sg WHERE top AND unit = 'root' AND document_id % 41 = 3),
re AS (SELECT document_id, stage || ':c' AS claim_id FROM sg WHERE top AND unit = 'root' UNION SELECT l.document_id, l.dst FROM re JOIN lg l ON l.document_id = re.document_id AND l.src = re.claim_id),
sc AS (SELECT cl.*, re.claim_id IS NOT NULL AS reached FROM cl LEFT JOIN re USING (document_id, claim_id)),
dd AS (SELECT document_id, stage AS root, {_DIGEST_STATE} AS status, document_id % 3 AS unsupported FROM sg WHERE top AND unit = 'root'),
fo AS (SELECT document_id, count(*) FILTER (sequence IS NOT NULL) AS findings, string_agg(stage || '|' || claim_id || '|' || text, ';' ORDER BY sequence) FILTER (sequence IS NOT NULL) AS f,
  count(q) FILTER (reached) AS qualifications, string_agg(q, ';' ORDER BY sequence NULLS LAST, stage) FILTER (reached) AS q, bool_or(sequence IS NOT NULL AND NOT reached) AS lost FROM sc GROUP BY document_id),
sd AS (SELECT document_id, subject, string_agg(claim_id, ',' ORDER BY sequence) FILTER (stance = 'affirmed') AS yes, string_agg(claim_id, ',' ORDER BY sequence) FILTER (stance = 'denied') AS no FROM sc WHERE sequence IS NOT NULL GROUP BY ALL),
ct AS (SELECT document_id, count(*) AS contradictions, string_agg(subject || '|' || yes || '|' || no, ';' ORDER BY subject) AS c FROM sd WHERE yes IS NOT NULL AND no IS NOT NULL GROUP BY document_id),
se AS (SELECT document_id, count(*) AS sections, string_agg(unit || '|' || stage || '|' || text, ';' ORDER BY CAST(split_part(unit, ':', 2) AS BIGINT)) AS s FROM sc WHERE top AND unit NOT IN ('root', 'fallback') GROUP BY document_id),
nt AS (SELECT document_id, 'limitation' AS kind, limitation AS text FROM cg WHERE limitation <> 'none' UNION SELECT document_id, 'question', 'question ' || sequence % 2 FROM cg WHERE sequence % 5 = 0
  UNION SELECT document_id, 'limitation', 'Incomplete source coverage; this digest is not complete publishable knowledge.' FROM dd WHERE status <> 'COMPLETE'
  UNION SELECT document_id, 'question', 'Content unavailable for unsupported or unextractable source units.' FROM dd WHERE unsupported > 0
  UNION SELECT document_id, 'question', 'Conflicting source propositions remain unresolved.' FROM ct),
nn AS (SELECT document_id, string_agg(text, ';' ORDER BY text) FILTER (kind = 'limitation') AS l, string_agg(text, ';' ORDER BY text) FILTER (kind = 'question') AS u FROM nt GROUP BY document_id)
SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM re WHERE claim_id = 'ghost') THEN 'evidence_validation_failed' WHEN lost THEN 'coverage_failed' ELSE 'ok' END AS verdict, status, dd.root,
  (SELECT any_value(text) FROM cl WHERE cl.document_id = dd.document_id AND cl.stage = dd.root) AS summary, coalesce(sections, 0) AS sections, md5(coalesce(s, '')) AS sections_md5, findings, md5(coalesce(f, '')) AS findings_md5,
  qualifications, md5(coalesce(q, '')) AS qualifications_md5, coalesce(contradictions, 0) AS contradictions, md5(coalesce(c, '')) AS contradictions_md5, coalesce(l, '') AS limitations, coalesce(u, '') AS questions
FROM dd JOIN fo USING (document_id) LEFT JOIN ct USING (document_id) LEFT JOIN se USING (document_id) LEFT JOIN nn USING (document_id)""")
def digest_rollup(t):
    chunks, edges, stages = _stages(t)
    name = lambda c: F.concat(c, F.lit(":c"))
    claims = stages.where("outcome = 'analyzed'").select(
        "document_id", "stage", F.lit(0).alias("position"), name("stage").alias("claim_id"),
        F.concat(F.when(F.col("sequence").isNull(), "commentary ").otherwise("fact "), F.col("links").cast("string")).alias("text"),
        "subject", "stance", F.array_compact(F.array("q")).alias("qualifications"),
    )
    gone = stages.where("outcome = 'unavailable'").select("document_id", F.col("stage").alias("child"))
    linked = edges.where((F.col("document_id") + F.length("child")) % 37 != 5).join(gone, ["document_id", "child"], "left_anti")
    roots = stages.where("top AND unit = 'root'")
    lineage = linked.select("document_id", name("stage").alias("claim_id"), name("child").alias("child_id")).unionByName(
        roots.where("document_id % 41 = 3").select("document_id", name("stage").alias("claim_id"), F.lit("ghost").alias("child_id"))
    )
    documents = roots.select("document_id", F.col("stage").alias("root"), F.expr(_DIGEST_STATE).alias("status"), (F.col("document_id") % 3).alias("unsupported"))
    order = F.substring_index("unit", ":", -1).cast("bigint")
    sections = stages.where("top AND unit NOT IN ('root', 'fallback')").select("document_id", "unit", order.alias("ord"), "stage")
    notes = chunks.where("limitation <> 'none'").select("document_id", F.lit("limitation").alias("kind"), F.col("limitation").alias("text")).unionByName(
        chunks.where("sequence % 5 = 0").select("document_id", F.lit("question").alias("kind"), F.concat(F.lit("question "), (F.col("sequence") % 2).cast("string")).alias("text"))
    )
    out = dg.assemble_digests(documents, stages.select("document_id", "stage", "sequence", "outcome"), claims, lineage, sections, notes)
    text = {
        "sections": lambda x: F.concat_ws("|", x["unit"], x["stage"], x["text"]), "findings": lambda x: F.concat_ws("|", x["stage"], x["claim_id"], x["text"]), "qualifications": lambda x: x,
        "contradictions": lambda x: F.concat_ws("|", x["subject"], F.array_join(x["affirmed"], ","), F.array_join(x["denied"], ",")),
    }
    lists = [c for n, f in text.items() for c in (F.size(n).cast("bigint").alias(n), F.md5(F.array_join(F.transform(n, f), ";")).alias(f"{n}_md5"))]
    return out.select("document_id", "verdict", "status", "root", "summary", *lists, *[F.array_join(n, ";").alias(n) for n in ("limitations", "questions")])


view("pinned", "SELECT s_suppkey AS document_id FROM {supplier} WHERE s_acctbal > 5000")


@query("annotations", f"""WITH {CONFLICT}
SELECT document_id, 'conflicting_finding' AS kind, text FROM cf WHERE document_id IN (SELECT document_id FROM {{pinned}})
UNION ALL SELECT DISTINCT document_id, kind, text FROM {{digest_notes}} WHERE document_id IN (SELECT document_id FROM {{pinned}})""")
def annotations(t):
    from foliant.operators.publication import annotations as annotate

    conflicts = dg.contradictions(t.stance_claims, ["document_id"])
    return annotate(t.stance_claims, conflicts, t.digest_notes, t.pinned)


view("facts", "SELECT doc_id AS document_id, block_no AS page, text, block_no % 2 = 0 AS preserve FROM {blocks}")
view("fact_findings", "SELECT doc_id AS document_id, concat(CAST(doc_id AS STRING), ':', CAST(block_no AS STRING)) AS finding_id, text, (doc_id + block_no) % 4 <> 0 AS qualified FROM {blocks} WHERE doc_id % 3 <> 0")
view("fact_excerpts", "SELECT concat(CAST(doc_id AS STRING), ':', CAST(block_no AS STRING)) AS finding_id, block_no + CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END AS page, CASE WHEN doc_id % 10 = 2 THEN upper(text) ELSE concat('> ', text) END AS text FROM {blocks}")


@query("fact_match", """WITH h AS (SELECT f.document_id, f.page, f.text, f.preserve, count(DISTINCT g.finding_id) AS findings, coalesce(bool_and(e.page = f.page) FILTER (e.text IS NOT NULL), false) AS cv,
  coalesce(bool_or(contains(e.text, f.text)), false) AS ct, coalesce(bool_or(g.qualified), false) AS q
  FROM {facts} f LEFT JOIN {fact_findings} g ON g.document_id = f.document_id AND g.text = f.text LEFT JOIN {fact_excerpts} e USING (finding_id) GROUP BY ALL)
SELECT document_id, page, findings, cv AND ct AS supported, NOT preserve OR q AS preserved FROM h""")
def fact_match(t):
    return dg.fact_match(t.facts, t.fact_findings, t.fact_excerpts).drop("text")
