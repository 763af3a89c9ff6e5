"""The fixture views as SQL, for the checks of the registered queries."""

from __future__ import annotations

HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_cls": (
        (),
        "SELECT d.doc_id AS row_id, d.lang, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)",
    ),
    "fx_dialog_array": (
        (),
        "SELECT conv_id AS row_id, list(text ORDER BY turn) AS dialog FROM conversations GROUP BY conv_id",
    ),
    "fx_translation": (
        (),
        """SELECT conv_id * 100 + turn AS row_id, text AS aa, nxt AS bb
        FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
        WHERE nxt IS NOT NULL""",
    ),
    "fx_choice": (
        (),
        """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
        c_name AS question, t AS texts, c_mktsegment AS answer,
        ['A','B','C','D','E'][list_position(t, c_mktsegment)] AS answerKey
        FROM customer, (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS t FROM customer) s""",
    ),
    "fx_extractive": (
        (),
        """SELECT d.doc_id AS row_id, d.text AS context, d.source AS question, l.doc_id IS NOT NULL AS known,
        CASE WHEN l.doc_id IS NULL THEN NULL ELSE split_part(d.text, '.', 1) END AS first_answer
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    ),
    "fx_features": (
        (),
        """SELECT vec_id AS sample_id, embedding::DOUBLE[] AS features, label, label >= 8 AS is_ood,
        label < 8 AND vec_id % 2 = 0 AS is_ref FROM embeddings""",
    ),
    "fx_elems": (
        ("fx_features",),
        """SELECT sample_id, label, is_ood, is_ref, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS i
        FROM fx_features""",
    ),
    "fx_logits": (
        ("fx_features", "fx_elems"),
        """SELECT f.sample_id, f.label, f.is_ood, f.is_ref, list(list_dot_product(f.features, k.c) ORDER BY k.label) AS logits
        FROM fx_features f, (SELECT label, list(c ORDER BY i) AS c FROM
          (SELECT label, i, avg(v) AS c FROM fx_elems WHERE is_ref GROUP BY label, i) GROUP BY label) k
        GROUP BY f.sample_id, f.label, f.is_ood, f.is_ref""",
    ),
    "fx_beams": (
        ("fx_features", "fx_elems", "fx_logits"),
        """SELECT sample_id // 4 AS sample_id, (sample_id % 4)::INT AS seq_id, label, is_ood, is_ref, logits,
        list_max(logits) AS likelihood FROM fx_logits""",
    ),
    "fx_hyps": (
        (),
        r"""SELECT conv_id * 100 + turn AS sample_id, s.seq_id::INT AS seq_id, text AS ref,
        array_to_string(list_filter(regexp_split_to_array(text, '\s+'),
          lambda w, i: substr(md5(concat_ws(':', s.seq_id, conv_id, turn, i - 1)), 1, 8) >= '33333333'), ' ') AS hyp
        FROM conversations, (SELECT unnest(range(4)) AS seq_id) s""",
    ),
    "fx_token_scores": (
        (),
        r"""SELECT doc_id AS sample_id, s.seq_id::INT AS seq_id, lang,
        list_transform(regexp_split_to_array(text, '\s+'), lambda w: (length(w) + s.seq_id)::DOUBLE / 10) AS token_scores
        FROM documents, (SELECT unnest(range(2)) AS seq_id) s""",
    ),
}


def using(*names: str, body: str, **ctes: str) -> str:
    """A query over fixture views and further named steps."""
    wanted: list[str] = []
    for name in names:
        for needed in (*VIEWS[name][0], name):
            if needed not in wanted:
                wanted.append(needed)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in wanted] + [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def log_softmax(logits: str, temperature: str = "1.0") -> str:
    norm = (
        f"(list_max({logits}) / {temperature} + ln(list_sum(list_transform({logits}, "
        f"lambda y: exp((y - list_max({logits})) / {temperature})))))"
    )
    return f"list_transform({logits}, lambda x: x / {temperature} - {norm})"


def six_off_ties(expression: str) -> str:
    return f"round({expression} + 1e-9, 6)"


def six(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"
