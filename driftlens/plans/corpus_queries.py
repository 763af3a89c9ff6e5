"""Queries over sources, adapters, perturbations, filters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlens.operators import adapters as A
from driftlens.operators import aggregates, dialog, filters, perturb, splits
from driftlens.operators.negatives import answer_pool, random_negative, replace_answer
from driftlens.operators.prompts import TEMPLATES, choice_list, prompt
from driftlens.operators.splits import Piece
from driftlens.plans import views as V
from driftlens.plans.registry import query
from driftlens.plans.sqlviews import HASH, using
from driftlens.session import scratch_path
from driftlens.sources import corpus, records

# --- sources and sinks ---------------------------------------------------------------------------


@query(
    "src_corpus",
    """SELECT 'train' AS split, doc_id AS row_id, text FROM documents
    UNION ALL SELECT 'test', item_id, text FROM benchmark""",
)
def src_corpus(spark, sf_dir):
    files = {"train": "documents", "test": "benchmark"}
    both = corpus.read_corpus(spark, sf_dir, "texts", layout=lambda s: f"{sf_dir}/{files.get(s, 'absent')}.parquet", optional=("validation",))
    return both.select("split", F.coalesce("doc_id", "item_id").alias("row_id"), "text")


@query("src_pair_fallback", using("fx_translation", body="SELECT row_id, 'train' AS split, aa AS source, bb AS target FROM fx_translation"))
def src_pair_fallback(spark, sf_dir):
    root = scratch_path(spark, "pairs")
    stored = V.translations(spark, sf_dir).withColumn("split", F.lit("train"))
    corpus.write_corpus(stored, root, "turns", "bb-aa", ("train",))
    return corpus.read_pair(spark, root, "turns", "aa-bb", ("train",))


@query("src_disk", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def src_disk(spark, sf_dir):
    pages = corpus.read_saved(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query(
    "src_ingest_sweep",
    """SELECT 'documents' AS name, 'ok' AS status, count(*) AS rows, false AS has_error FROM documents
    UNION ALL SELECT 'conversations', 'ok', count(*), false FROM conversations
    UNION ALL SELECT 'labels', 'ok', count(*), false FROM labels UNION ALL SELECT 'absent', 'failed', 0, true""",
)
def src_ingest_sweep(spark, sf_dir):
    names = ("documents", "conversations", "labels", "absent")
    registry = {n: lambda s, n=n: corpus.read_saved(s, f"{sf_dir}/{n}.parquet") for n in names}
    report = corpus.ingest_all(spark, registry, scratch_path(spark, "ingest"))
    return report.select("name", "status", "rows", F.col("error").isNotNull().alias("has_error"))


def _lang_records(spark, sf_dir):
    """One record per document, its language as the scored set."""
    return V.documents(spark, sf_dir).select(
        F.lit("test").alias("phase"), F.lit("org/model").alias("model"), F.lit("en").alias("dataset_in"),
        F.col("lang").alias("dataset_out"), F.col("row_id").alias("sample_id"), F.col("n_chars").cast("double").alias("score"),
    )


@query(
    "sink_records",
    """SELECT 'test' AS phase, 'org_model' AS model, 'en' AS dataset_in, lang AS dataset_out, doc_id AS sample_id,
    n_chars::DOUBLE AS score, 'org_model_en_' || lang || '.json' AS file_name FROM documents""",
)
def sink_records(spark, sf_dir):
    root = scratch_path(spark, "records")
    records.write_records(_lang_records(spark, sf_dir), root)
    back = records.read_records(spark, root, phase="test", model="org/model")
    name = F.concat_ws("_", "model", "dataset_in", F.concat("dataset_out", F.lit(".json")))
    return back.select("phase", "model", "dataset_in", "dataset_out", "sample_id", "score", name.alias("file_name"))


@query("sink_json_round", "SELECT event_id, round(value / 7, 3) AS score FROM events")
def sink_json_round(spark, sf_dir):
    path = scratch_path(spark, "json")
    scores = V.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 7).alias("score"))
    records.write_json(scores, path)
    return spark.read.schema("event_id long, score double").json(path)


@query(
    "sink_append_merge",
    """SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE o.n_chars END AS score,
    o.lang AS lang FROM (SELECT doc_id, n_chars, lang FROM documents) o
    FULL JOIN (SELECT doc_id, quality::BIGINT AS quality FROM labels) n ON o.doc_id = n.doc_id""",
)
def sink_append_merge(spark, sf_dir):
    old = V.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"), "lang")
    new = V.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("score"))
    return records.merge_records(old, new, "doc_id")


@query(
    "sink_metadata",
    """SELECT doc_id, 'org/model' AS model, 'en' AS dataset_in, lang AS dataset_out, 42 AS seed, 'Translate: ' AS instruction,
    'hallucination' AS perturbation FROM documents""",
)
def sink_metadata(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset_out"))
    return records.with_metadata(
        docs, model="org/model", dataset_in="en", seed=42, instruction="Translate: ", perturbation="hallucination"
    )


# --- adapters ------------------------------------------------------------------------------------


@query(
    "prj_text_label",
    """SELECT doc_id AS row_id, source || ' ' || text AS text, 0 AS labels, 'pair' AS kind FROM documents
    UNION ALL SELECT doc_id, d.text, l.quality, 'single' FROM documents d JOIN labels l USING (doc_id)""",
)
def prj_text_label(spark, sf_dir):
    pair = A.to_classification(V.pairs(spark, sf_dir), "sentence1", "sentence2").withColumn("kind", F.lit("pair"))
    single = A.to_classification(V.labelled(spark, sf_dir), "text").withColumn("kind", F.lit("single"))
    return pair.unionByName(single)


@query("prj_source_target", "SELECT doc_id AS row_id, text AS source, source AS target FROM documents")
def prj_source_target(spark, sf_dir):
    return A.to_generation(V.documents(spark, sf_dir), "text", "source")


@query("prj_rename_label", using("fx_cls", body="SELECT row_id, text, label FROM fx_cls"))
def prj_rename_label(spark, sf_dir):
    raw = V.labelled(spark, sf_dir).withColumnsRenamed({"text": "TWEET", "label": "LABEL"})
    return A.rename_fields(raw, text="TWEET", label="LABEL")


@query(
    "prj_concat_fields",
    """SELECT d.doc_id AS row_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE d.source || ' ' || d.text END AS text
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def prj_concat_fields(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.lit(True).alias("known"))
    rows = V.pairs(spark, sf_dir).join(labels, "row_id", "left")
    return A.concat_fields(rows.withColumn("sentence2", F.when(F.col("known"), F.col("sentence2"))).drop("known"), "sentence1", "sentence2")


@query("prj_struct_pick", using("fx_translation", body="SELECT row_id, bb AS source, aa AS target FROM fx_translation"))
def prj_struct_pick(spark, sf_dir):
    return A.pick_pair(V.translations(spark, sf_dir), "bb", "aa")


@query(
    "prj_orient_pair",
    using("fx_translation", body="""SELECT row_id, CASE WHEN row_id // 100 % 2 = 0 THEN 'test' ELSE 'validation' END AS split,
    bb AS source, aa AS target FROM fx_translation"""),
)
def prj_orient_pair(spark, sf_dir):
    return A.orient_pair(V.oriented(spark, sf_dir), "bb")


@query(
    "prj_const_target",
    """SELECT doc_id AS row_id, text AS source, 'a' AS target FROM documents
    UNION ALL SELECT doc_id, text, text FROM documents""",
)
def prj_const_target(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("row_id", "text")
    return A.const_target(docs, "text", "a").unionByName(A.const_target(docs, "text", None))


@query("prj_first_elem", using("fx_extractive", body="SELECT row_id, first_answer AS answer FROM fx_extractive"))
def prj_first_elem(spark, sf_dir):
    rows = V.extractive(spark, sf_dir).select("row_id", F.col("answers.text").alias("texts"))
    return A.first_elem(rows, "texts", "answer", strict=False)


@query("prj_label_lookup", "SELECT c_custkey AS row_id, c_mktsegment AS answer FROM customer")
def prj_label_lookup(spark, sf_dir):
    return V.choices(spark, sf_dir).select("row_id", A.answer_of().alias("answer"))


@query("prj_cast_shift", using("fx_cls", body="SELECT row_id, label + 1 AS label FROM fx_cls"))
def prj_cast_shift(spark, sf_dir):
    stars = V.labelled(spark, sf_dir).select("row_id", F.col("label").cast("string").alias("star_rating"))
    return A.shift_label(stars, "star_rating", 1)


LANG_CODES = {"en": 0, "fr": 1, "de": 2, "es": 3}


@query(
    "prj_label_dict",
    "SELECT doc_id AS row_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS label FROM documents",
)
def prj_label_dict(spark, sf_dir):
    return A.map_labels(V.documents(spark, sf_dir).select("row_id", F.col("lang").alias("label")), LANG_CODES)


CODES_SQL = """SELECT event_type AS label, (row_number() OVER (ORDER BY event_type DESC) - 1)::INT AS code
    FROM (SELECT DISTINCT event_type FROM events)"""


@query("prj_label_codes", CODES_SQL)
def prj_label_codes(spark, sf_dir):
    return A.label_codes(V.categories(spark, sf_dir), "product_category")


@query(
    "jn_dict",
    f"WITH codes AS ({CODES_SQL}) SELECT event_id AS row_id, props AS review_body, code AS label FROM events JOIN codes ON event_type = codes.label",
)
def jn_dict(spark, sf_dir):
    rows = V.categories(spark, sf_dir)
    return A.lookup_labels(rows, A.label_codes(rows, "product_category"), "product_category")


@query(
    "prj_subset_label",
    "SELECT doc_id AS row_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS label FROM documents",
)
def prj_subset_label(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("row_id", "lang")
    return A.label_by_subset([docs.where(F.col("lang") == lang) for lang in LANG_CODES]).drop("lang")


@query("prj_tab_split", "SELECT c_custkey AS row_id, c_name AS source, c_mktsegment AS target FROM customer")
def prj_tab_split(spark, sf_dir):
    return A.parse_tsv_qa(V.tsv_lines(spark, sf_dir))


CHOICES_SQL = "array_to_string(texts, ' - ')"


@query(
    "prj_prompt",
    using("fx_choice", body=f"""SELECT row_id, 'Context:' || answer || ' ; Question: ' || question || ' ; Choices: ' || {CHOICES_SQL} AS openbookqa,
    'Context: ; Question: ' || question || ' ; Choices: ' || {CHOICES_SQL} AS ai2_arc,
    'Context: ' || answer || ' ; Question: ' || question AS coqa, 'Context:' || answer || ' ; Question: ' || question AS squad_v2,
    'Context:' || answer || ' ; Question: ' || array_to_string(texts, '- ') AS quartz,
    answer || '.' || chr(10) || ' ' || question AS natural_instructions FROM fx_choice"""),
)
def prj_prompt(spark, sf_dir):
    rows = V.choices(spark, sf_dir)
    offered = choice_list(F.col("choices.text"))
    filled = {
        name: prompt(TEMPLATES[name], context=A.answer_of(), question=F.col("question"), choices=offered).alias(name)
        for name in ("openbookqa", "ai2_arc", "coqa", "squad_v2", "natural_instructions")
    }
    quartz = prompt(TEMPLATES["quartz"], context=A.answer_of(), question=choice_list(F.col("choices.text"), "- "))
    return rows.select("row_id", *filled.values(), quartz.alias("quartz"))


@query("prj_flatten_newline", "SELECT doc_id AS row_id, 'Context: ' || replace(text, chr(10), ' ') || ' ; Question: ' || source AS source FROM documents")
def prj_flatten_newline(spark, sf_dir):
    docs = V.documents(spark, sf_dir).withColumn("search_context", F.array("text"))
    context = A.flatten_newlines(F.element_at("search_context", 1))
    return docs.select("row_id", prompt(TEMPLATES["trivia_qa"], context=context, question=F.col("source")).alias("source"))


@query(
    "prj_shuffle_choices",
    using("fx_choice", body="""SELECT row_id, string_agg(t, ' - ' ORDER BY md5(concat_ws(':', 42, row_id, t, i - 1)), t) AS choices
    FROM (SELECT row_id, unnest(texts) AS t, generate_subscripts(texts, 1) AS i FROM fx_choice) GROUP BY row_id"""),
)
def prj_shuffle_choices(spark, sf_dir):
    return V.choices(spark, sf_dir).select(
        "row_id", choice_list(A.shuffled(F.col("choices.text"), F.col("row_id"))).alias("choices")
    )


@query("prj_instruction", "SELECT doc_id AS row_id, 'Summarize: ' || text AS source FROM documents")
def prj_instruction(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("row_id", F.col("text").alias("source"))
    return A.add_instruction(docs, "Summarize: ")


# --- perturbations -------------------------------------------------------------------------------

TENTH = format(int(0.1 * 2**32), "08x")


def _upper_sql(text: str) -> str:
    return rf"""array_to_string(list_transform(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''),
    lambda w, i: CASE WHEN substr(md5(concat_ws(':', '42w', row_id, (i - 1) // 4)), (i - 1) % 4 * 8 + 1, 8) < '{TENTH}'
    THEN upper(replace(w, 'ß', 'SS')) ELSE w END), ' ')"""


DELETE_SQL = f"""array_to_string(list_filter(string_split(text, ''),
    lambda c, i: substr(md5(concat_ws(':', '42c', row_id, (i - 1) // 4)), (i - 1) % 4 * 8 + 1, 8) >= '{TENTH}'), '')"""
DOCS_SQL = "(SELECT doc_id AS row_id, text FROM documents)"


@query("ptb_upper_words", f"SELECT row_id, {_upper_sql('text')} AS text FROM {DOCS_SQL}")
def ptb_upper_words(spark, sf_dir):
    return V.texts(spark, sf_dir).select("row_id", perturb.upper_words(F.col("text"), F.col("row_id")).alias("text"))


@query("ptb_delete_chars", f"SELECT row_id, {DELETE_SQL} AS text FROM {DOCS_SQL}")
def ptb_delete_chars(spark, sf_dir):
    return V.texts(spark, sf_dir).select("row_id", perturb.delete_chars(F.col("text"), F.col("row_id")).alias("text"))


@query("ptb_hallucination", f"SELECT row_id, {_upper_sql('thin')} AS text FROM (SELECT row_id, {DELETE_SQL} AS thin FROM {DOCS_SQL})")
def ptb_hallucination(spark, sf_dir):
    return perturb.perturb(V.texts(spark, sf_dir).select("row_id", "text"), "hallucination", column="text")


# --- filters -------------------------------------------------------------------------------------


@query("flt_answerable", using("fx_extractive", body="SELECT row_id, known AS answerable, CASE WHEN known THEN first_answer ELSE 'None' END AS target FROM fx_extractive"))
def flt_answerable(spark, sf_dir):
    rows = V.extractive(spark, sf_dir)
    yes = filters.answerable(rows).select("row_id", F.lit(True).alias("answerable"), F.element_at("answers.text", 1).alias("target"))
    no = filters.answerable(rows, keep=False).select("row_id", F.lit(False).alias("answerable"), F.lit(A.NO_ANSWER).alias("target"))
    return yes.unionByName(no)


@query(
    "flt_score_keys",
    """SELECT doc_id AS sample_id, 'renyi(mode=token)' AS detector, n_chars AS score FROM documents""",
)
def flt_score_keys(spark, sf_dir):
    kinds = F.array(F.lit("renyi(mode=token)"), F.lit("renyi(mode=output)"))
    scores = V.documents(spark, sf_dir).select(F.col("row_id").alias("sample_id"), F.explode(kinds).alias("detector"), F.col("n_chars").alias("score"))
    return filters.score_keys(scores, "mode=token")


@query(
    "flt_skip_self",
    """SELECT DISTINCT a.lang AS dataset_in, b.lang AS dataset_out FROM documents a,
    (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id)) b WHERE a.lang <> b.lang""",
)
def flt_skip_self(spark, sf_dir):
    langs = V.documents(spark, sf_dir).select("lang").distinct()
    outs = langs.agg(F.collect_set("lang")).scalar()
    grid = langs.select(F.col("lang").alias("dataset_in"), F.explode(outs).alias("dataset_out"))
    loaded = V.labelled(spark, sf_dir).select(F.col("lang").alias("name"))
    return filters.skip_self(grid, loaded).select("dataset_in", "dataset_out")


@query(
    "flt_nonempty_splits",
    """SELECT e.split, count(d.doc_id) AS n, count(d.doc_id) > 0 AS ok FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) e(split)
    LEFT JOIN documents d ON d.lang = e.split GROUP BY e.split""",
)
def flt_nonempty_splits(spark, sf_dir):
    docs = V.documents(spark, sf_dir).withColumn("split", F.col("lang"))
    return filters.nonempty_splits(docs, ("en", "fr", "de", "es", "it"))


# --- limits and splits ---------------------------------------------------------------------------

# Documents as a published corpus: English trains, French validates, the others test.
SPLIT_SQL = "CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'validation' ELSE 'test' END"
NUMBERED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS rn, count(*) OVER (PARTITION BY split) AS n
    FROM (SELECT doc_id AS row_id, {SPLIT_SQL} AS split, lang FROM documents)"""


def published(spark, sf_dir):
    lang = F.col("lang")
    split = F.when(lang == "en", "train").when(lang == "fr", "validation").otherwise("test")
    return V.documents(spark, sf_dir).select("row_id", split.alias("split"), "lang")


@query(
    "lim_cap",
    f"""SELECT 'first' AS kind, split, row_id FROM ({NUMBERED_SQL}) WHERE rn < CASE split WHEN 'train' THEN 100 WHEN 'validation' THEN 40 ELSE 0 END
    UNION ALL SELECT 'all_but_last', split, row_id FROM ({NUMBERED_SQL}) WHERE rn < n - 1""",
)
def lim_cap(spark, sf_dir):
    rows = published(spark, sf_dir)
    first = splits.cap(rows, {"train": 100, "validation": 40, "test": 0}).withColumn("kind", F.lit("first"))
    rest = splits.cap(rows, -1).withColumn("kind", F.lit("all_but_last"))
    return first.unionByName(rest).select("kind", "split", "row_id")


ALL_NUMBERED_SQL = "SELECT doc_id AS row_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents"


@query(
    "lim_slice",
    f"""SELECT 'middle' AS kind, row_id FROM ({ALL_NUMBERED_SQL}) WHERE rn >= 50 AND rn < 150
    UNION ALL SELECT 'open', row_id FROM ({ALL_NUMBERED_SQL}) WHERE rn >= 120
    UNION ALL SELECT 'past', row_id FROM ({ALL_NUMBERED_SQL}) WHERE rn >= 1000000""",
)
def lim_slice(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("row_id")
    kinds = {"middle": (50, 150), "open": (120, None), "past": (1_000_000, 1_002_000)}
    return splits.union_all(*[splits.slice_rows(docs, *s).select(F.lit(k).alias("kind"), "row_id") for k, s in kinds.items()])


@query(
    "lim_tail",
    f"""SELECT 'tail' AS kind, row_id FROM ({ALL_NUMBERED_SQL}) WHERE rn >= n - 75
    UNION ALL SELECT 'head', row_id FROM ({ALL_NUMBERED_SQL}) WHERE rn < n - 75""",
)
def lim_tail(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("row_id")
    tail = splits.tail_rows(docs, 75).select(F.lit("tail").alias("kind"), "row_id")
    return tail.unionByName(splits.slice_rows(docs, None, -75).select(F.lit("head").alias("kind"), "row_id"))


@query(
    "spl_fraction",
    f"""SELECT row_id, CASE WHEN rn < floor(0.7 * n) THEN 'train' WHEN rn < floor(0.7 * n) + floor(0.2 * n) THEN 'validation' ELSE 'test' END AS split
    FROM ({ALL_NUMBERED_SQL})""",
)
def spl_fraction(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("row_id")
    return splits.split_fraction(docs, [0.7, 0.2], ("train", "validation", "test"))


SHUFFLE_KEY = HASH.format("concat_ws(':', 42, {})")


def _shuffled_sql(rows: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = SHUFFLE_KEY.format("row_id")
    return f"SELECT *, row_number() OVER ({part} ORDER BY {key}, row_id) - 1 AS place, count(*) OVER ({part}) AS size FROM ({rows})"


@query(
    "spl_holdout",
    f"""SELECT row_id, CASE WHEN place < size - floor(0.1 * size) THEN 'train' ELSE 'validation' END AS split
    FROM ({_shuffled_sql('SELECT doc_id AS row_id FROM documents')})""",
)
def spl_holdout(spark, sf_dir):
    return splits.holdout(V.documents(spark, sf_dir).select("row_id"), 0.1)


@query(
    "spl_prefix_holdout",
    f"""SELECT row_id, CASE WHEN place < size - floor(0.1 * size) THEN 'train' ELSE 'validation' END AS split
    FROM ({_shuffled_sql(f'SELECT row_id FROM ({ALL_NUMBERED_SQL}) WHERE rn < n // 10')})""",
)
def spl_prefix_holdout(spark, sf_dir):
    return splits.prefix_holdout(V.documents(spark, sf_dir).select("row_id"))


STRATIFIED_SQL = f"""SELECT row_id, lang, CASE WHEN place < floor(0.8 * size) THEN 'train'
    WHEN place < floor(0.8 * size) + floor(0.1 * size) THEN 'validation' ELSE 'test' END AS split
    FROM ({_shuffled_sql('SELECT doc_id AS row_id, lang FROM documents', 'lang')})"""


@query("spl_stratified", STRATIFIED_SQL)
def spl_stratified(spark, sf_dir):
    return splits.split_stratified(V.documents(spark, sf_dir).select("row_id", "lang"), "lang")


@query("win_rank_split", f"SELECT lang, split, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM ({STRATIFIED_SQL}) GROUP BY lang, split")
def win_rank_split(spark, sf_dir):
    rows = splits.split_stratified(V.documents(spark, sf_dir).select("row_id", "lang"), "lang")
    return rows.groupBy("lang", "split").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")
    )


@query(
    "spl_recompose",
    f"""WITH t AS ({NUMBERED_SQL}) SELECT 'train' AS split, 0 AS part, row_id FROM t WHERE split = 'train' AND rn < n - 50
    UNION ALL SELECT 'validation', 1, row_id FROM t WHERE split = 'validation' AND rn < 30
    UNION ALL SELECT 'validation', 2, row_id FROM t WHERE split = 'train' AND rn >= n - 50
    UNION ALL SELECT 'test', 3, row_id FROM t WHERE split = 'validation' AND rn >= 30
    UNION ALL SELECT 'test', 4, row_id FROM t WHERE split = 'test'""",
)
def spl_recompose(spark, sf_dir):
    recipe = [
        Piece("train", "train", None, -50),
        Piece("validation", "validation", None, 30),
        Piece("validation", "train", -50),
        Piece("test", "validation", 30),
        Piece("test", "test"),
    ]
    return splits.recompose(published(spark, sf_dir), recipe).select("split", "part", "row_id")


@query(
    "spl_overlap_replicate",
    f"""WITH t AS ({NUMBERED_SQL}) SELECT 'train' AS split, p.part::INT AS part, row_id FROM t, (SELECT unnest(range(3)) AS part) p WHERE split = 'train' AND rn < 100
    UNION ALL SELECT 'validation', 3, row_id FROM t WHERE split = 'train' AND rn >= 50 AND rn < 120
    UNION ALL SELECT 'test', 4, row_id FROM t WHERE split = 'train' AND rn >= 120""",
)
def spl_overlap_replicate(spark, sf_dir):
    recipe = [Piece("train", "train", None, 100, 3), Piece("validation", "train", 50, 120), Piece("test", "train", 120)]
    return splits.recompose(published(spark, sf_dir), recipe).select("split", "part", "row_id")


# --- sets, joins, aggregates, windows ------------------------------------------------------------


@query("set_union_all", "SELECT lang, text FROM documents UNION ALL SELECT lang, text FROM documents JOIN labels USING (doc_id)")
def set_union_all(spark, sf_dir):
    return splits.union_all(V.documents(spark, sf_dir).select("lang", "text"), V.labelled(spark, sf_dir).select("lang", "text"))


@query("set_distinct", "SELECT DISTINCT event_type AS product_category FROM events")
def set_distinct(spark, sf_dir):
    return aggregates.distinct_values(V.categories(spark, sf_dir), "product_category")


@query(
    "jn_zip_explode",
    """WITH a AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS q, list(text ORDER BY turn) FILTER (role = 'assistant') AS a
    FROM conversations GROUP BY conv_id)
    SELECT row_id, (i - 1)::INT AS pos, q[i] AS question, a[i] AS answer FROM
    (SELECT conv_id AS row_id, q, a, unnest(range(1, least(len(q), len(a)) + 1)) AS i FROM a WHERE q IS NOT NULL AND a IS NOT NULL)""",
)
def jn_zip_explode(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")

    def texts(role):
        kept = F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))
        return F.transform(F.array_sort(kept), lambda s: s["text"])

    rows = turns.groupBy(F.col("conv_id").alias("row_id")).agg(texts("user").alias("questions"), texts("assistant").alias("replies"))
    return A.zip_explode(rows, "questions", "replies", ("question", "answer"))


POOL_SQL = "SELECT split, unnest(texts) AS answer FROM fx_choice"


@query("agg_answer_pool", using("fx_choice", body=f"SELECT split, answer, count(*) AS n FROM ({POOL_SQL}) GROUP BY split, answer"))
def agg_answer_pool(spark, sf_dir):
    return answer_pool(V.choices(spark, sf_dir), "choices.text")


PLACES_SQL = f"""SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY h, answer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(n) OVER (PARTITION BY split) AS size
    FROM (SELECT split, answer, count(*) AS n, {HASH.format('answer')} AS h FROM ({POOL_SQL}) GROUP BY split, answer)"""
DRAWS_SQL = f"""SELECT c.row_id, c.split, c.question, c.texts, c.answer, p.start, p.n,
    {SHUFFLE_KEY.format('c.row_id')} % (p.size - p.n) AS draw FROM fx_choice c JOIN places p ON p.split = c.split AND p.answer = c.answer"""


@query(
    "jn_random_negative",
    using(
        "fx_choice", places=PLACES_SQL, draws=DRAWS_SQL,
        body="""SELECT d.row_id, d.split, 'Context: ; Question: ' || d.question || ' ; Choices: ' ||
        array_to_string(list_transform(d.texts, lambda t: CASE WHEN t = d.answer THEN p.answer ELSE t END), ' - ') AS source, 'None' AS target
        FROM draws d JOIN places p ON p.split = d.split
        AND d.draw + CASE WHEN d.draw >= d.start THEN d.n ELSE 0 END >= p.start
        AND d.draw + CASE WHEN d.draw >= d.start THEN d.n ELSE 0 END < p.start + p.n""",
    ),
)
def jn_random_negative(spark, sf_dir):
    rows = V.choices(spark, sf_dir)
    good = rows.withColumn("_good", A.answer_of())
    drawn = random_negative(good, answer_pool(rows, "choices.text"), "_good")
    swapped = drawn.withColumn("choices", replace_answer("choices", "answerKey", "negative"))
    source = prompt(TEMPLATES["ai2_arc"], question=F.col("question"), choices=choice_list(F.col("choices.text")))
    return A.to_generation(swapped, source, F.lit(A.NO_ANSWER))


@query("agg_split_sizes", f"SELECT split, count(*) AS n FROM (SELECT {SPLIT_SQL} AS split FROM documents) GROUP BY split")
def agg_split_sizes(spark, sf_dir):
    return aggregates.split_sizes(published(spark, sf_dir))


@query(
    "agg_idf",
    r"""WITH tagged AS (SELECT text, 1 AS counts FROM documents UNION ALL SELECT text, 0 FROM benchmark),
    told AS (SELECT counts, unnest(list_distinct(regexp_split_to_array(text, '\s+'))) AS token FROM tagged),
    seen AS (SELECT token, sum(counts)::BIGINT AS df FROM told WHERE token <> '' GROUP BY token),
    f AS MATERIALIZED (SELECT token, df, ln((n + 1) / (df + 1)) AS idf FROM seen, (SELECT count(*) AS n FROM documents)),
    whole AS (SELECT sum(idf) AS total FROM f)
    SELECT token, df, round(idf, 9) AS idf, round(idf / total, 12) AS weight FROM f, whole""",
)
def agg_idf(spark, sf_dir):
    docs = V.texts(spark, sf_dir).select("text")
    weights = aggregates.idf(docs, "text", V.table(spark, sf_dir, "benchmark").select("text"))
    return weights.select("token", "df", F.round("idf", 9).alias("idf"), F.round("weight", 12).alias("weight"))


DIALOG_SQL = """SELECT conv_id, turn, string_agg(text || '</s>', '') OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations"""


@query("win_dialog", f"SELECT * FROM ({DIALOG_SQL}) WHERE target IS NOT NULL")
def win_dialog(spark, sf_dir):
    return dialog.accumulate_dialog(V.dialogs(spark, sf_dir))


@query("win_dialog_array", f"SELECT conv_id AS row_id, turn::INT AS turn, source, target FROM ({DIALOG_SQL}) WHERE target IS NOT NULL")
def win_dialog_array(spark, sf_dir):
    return dialog.accumulate_dialog_array(V.dialog_arrays(spark, sf_dir))
