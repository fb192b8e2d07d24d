"""The queries of the catalogue again, as SQL over the same tables.

Each statement is put together from named common table expressions; only those a
query needs, directly or through others, are written out.
"""

import re

# Fixed values, stated here again so that the SQL does not lean on the code it checks:
# Python's white space, the published tokenizer's blocks of ideographs, its length limit,
# longest word and marker tokens.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)
WHITESPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
IDEOGRAPHS = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
]
MAX_LEN, MAX_WORD_CHARS = 128, 100
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")

CONTROL = r"[^\P{C}\t\n\r]|\x{fffd}"
ALONE = r"[:punct:]\p{P}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in IDEOGRAPHS)
WORD = f"[{ALONE}]|[^{ALONE}{WHITESPACE_CLASS}]+"
LIMIT = MAX_LEN - 2
SIZE = 32
EPS = "CAST(1e-7 AS DOUBLE)"


def _strip(text: str) -> str:
    return f"trim(coalesce({text}, ''), '{WHITESPACE}')"


def _n_tokens(text: str) -> str:
    pieces = f"len(regexp_split_to_array({text}, '[{WHITESPACE_CLASS}]+'))"
    return f"CAST(CASE WHEN {text} = '' THEN 0 ELSE {pieces} END AS INTEGER)"


def _words(text: str) -> str:
    bare = f"strip_accents(lower(regexp_replace(coalesce({text}, ''), '{CONTROL}', '', 'g')))"
    return f"regexp_extract_all({bare}, '{WORD}')"


def _cut(name: str, source: str, seed: int) -> dict[str, str]:
    """Rows of ``source`` with their rank in class by seeded hash, and the class quota."""
    return {
        f"{name}_n": f"""
            SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total
            FROM {source} GROUP BY label""",
        f"{name}_share": f"""
            SELECT *, total - CAST(ceil(CAST(0.2 AS DOUBLE) * total) AS BIGINT) AS kept,
                   CAST(n AS DOUBLE) * kept / total AS share,
                   CAST(floor(share) AS BIGINT) AS whole
            FROM {name}_n""",
        f"{name}_quota": f"""
            SELECT label, whole + CASE WHEN
                   row_number() OVER (ORDER BY share - whole DESC, label)
                   <= kept - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
            FROM {name}_share""",
        f"{name}_rank": f"""
            SELECT doc_id, label, row_number() OVER (
                   PARTITION BY label ORDER BY md5('{seed}:' || doc_id), doc_id) AS nth
            FROM {source}""",
        name: f"""
            SELECT r.doc_id, r.label, r.nth > q.quota AS beyond
            FROM {name}_rank r JOIN {name}_quota q USING (label)""",
    }


def _class_array(template: str, classes: int, separator: str = ", ") -> str:
    return separator.join(template.format(c=c) for c in range(classes))


def _ctes(classes: int, flag: str = "quality") -> dict[str, str]:
    return {
        "docs": """
            SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label, text
            FROM documents"""
        if classes == 4
        else f"""
            SELECT d.doc_id, CAST(l.{flag} AS INTEGER) AS label, d.text
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
        "segments": """
            SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS text
            FROM (SELECT doc_id, string_split(text, '.') AS parts FROM documents)""",
        "stripped": f"""
            SELECT * FROM (SELECT doc_id, label, {_strip('text')} AS text FROM docs)
            WHERE text <> ''""",
        "counted": f"SELECT *, {_n_tokens('text')} AS n_tokens FROM stripped",
        "copies": """
            SELECT *, row_number() OVER (PARTITION BY label, text ORDER BY doc_id) AS nth
            FROM counted""",
        "kept": "SELECT * FROM copies WHERE nth = 1",
        "clean": "SELECT * FROM kept WHERE n_tokens NOT BETWEEN 1 AND 5",
        **_cut("cut1", "clean", 42),
        "rest": "SELECT doc_id, label FROM cut1 WHERE NOT beyond",
        **_cut("cut2", "rest", 43),
        "parts": """
            SELECT c.doc_id, c.label, c.text, CASE WHEN cut1.beyond THEN 'test'
                   WHEN cut2.beyond THEN 'valid' ELSE 'train' END AS split
            FROM clean c JOIN cut1 ON c.doc_id = cut1.doc_id
            LEFT JOIN cut2 ON c.doc_id = cut2.doc_id""",
        "weights": """
            SELECT label, count(*) AS n_rows,
                   1 - count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight
            FROM parts WHERE split = 'train' GROUP BY label""",
        "worded": f"SELECT *, {_words('text')} AS words FROM parts",
        # vocabulary
        "word_n": f"""
            SELECT word, count(*) AS n
            FROM (SELECT unnest(words) AS word FROM worded WHERE split = 'train') GROUP BY word""",
        "frequent": "SELECT word AS token, n FROM word_n WHERE n >= 2 AND length(word) > 1",
        "letters": """
            SELECT CASE WHEN pos = 1 THEN '' ELSE '##' END || substring(word, pos, 1) AS token, n
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM word_n)""",
        "alphabet": """
            SELECT token, CAST(sum(n) AS BIGINT) AS n FROM letters GROUP BY token""",
        "vocab": "SELECT * FROM (VALUES "
        + ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL_TOKENS))
        + f""") AS s(token, id) UNION ALL
            SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + {len(SPECIAL_TOKENS) - 1}
                   AS INTEGER) FROM (SELECT token, max(n) AS n FROM
                   (SELECT * FROM frequent UNION ALL SELECT * FROM alphabet) GROUP BY token)""",
        # word pieces
        "lead": f"""
            SELECT doc_id, label, split, CAST(len(words) AS INTEGER) AS n_words,
                   words[1:{LIMIT}] AS lead FROM worded""",
        "occurrence": """
            SELECT doc_id, unnest(lead) AS word, generate_subscripts(lead, 1) AS at_word
            FROM lead""",
        "lexicon": "SELECT DISTINCT word FROM occurrence",
        "unlisted": "SELECT word FROM lexicon WHERE word NOT IN (SELECT token FROM vocab)",
        "starts": f"""
            SELECT word, unnest(range(0, length(word))) AS pos
            FROM unlisted WHERE length(word) <= {MAX_WORD_CHARS}""",
        "spans": "SELECT word, pos, unnest(range(1, length(word) - pos + 1)) AS size FROM starts",
        "longest": """
            SELECT word, pos, max(size) AS size, arg_max(id, size) AS id
            FROM spans JOIN vocab ON token =
                 CASE WHEN pos = 0 THEN '' ELSE '##' END || substring(word, pos + 1, size)
            GROUP BY word, pos""",
        "walk": """
            SELECT word, CAST(0 AS BIGINT) AS pos, CAST([] AS INTEGER[]) AS ids FROM unlisted
            UNION ALL
            SELECT w.word, w.pos + g.size, list_append(w.ids, g.id)
            FROM walk w JOIN longest g ON w.word = g.word AND w.pos = g.pos""",
        "pieces": """
            SELECT l.word, CASE WHEN v.id IS NULL THEN coalesce(w.ids, [1]) ELSE [v.id] END AS ids
            FROM lexicon l LEFT JOIN vocab v ON v.token = l.word
            LEFT JOIN walk w ON l.word = w.word AND w.pos = length(l.word)""",
        "doc_pieces": """
            SELECT doc_id, flatten(list(ids ORDER BY at_word)) AS ids
            FROM occurrence JOIN pieces USING (word) GROUP BY doc_id""",
        "encoded": f"""
            SELECT l.doc_id, l.label, l.split, l.n_words, coalesce(p.ids, []) AS ids,
                   l.n_words > {LIMIT} OR len(coalesce(p.ids, [])) > {LIMIT} AS truncated,
                   least(len(coalesce(p.ids, [])), {LIMIT}) + 2 AS n_real,
                   [2] || coalesce(p.ids, [])[1:{LIMIT}] || [3]
                   || list_transform(range(n_real, {MAX_LEN}), lambda x: 0) AS token_ids,
                   list_transform(range(0, {MAX_LEN}), lambda x: CASE WHEN x < n_real THEN 1 ELSE 0 END)
                   AS attention_mask
            FROM lead l LEFT JOIN doc_pieces p USING (doc_id)""",
        # model
        "doc_tokens": "SELECT doc_id, label, split, unnest(words) AS token FROM worded",
        "model_tokens": """
            SELECT label, token, count(*) AS n FROM doc_tokens
            WHERE split = 'train' GROUP BY label, token""",
        "mass": """
            SELECT label, ln(weight * n_rows / sum(weight * n_rows) OVER ()) AS prior FROM weights""",
        "listed": f"""
            SELECT token, sum(n) AS n, {_class_array(
                'CAST(coalesce(sum(n) FILTER (label = {c}), 0) AS DOUBLE) AS m{c}', classes)}
            FROM model_tokens GROUP BY token HAVING sum(n) >= 2""",
        "scores": "SELECT token, "
        + _class_array(
            "ln((m{c} + 1) / (sum(m{c}) OVER () + count(*) OVER ())) AS s{c}", classes
        )
        + " FROM listed",
        "sums": "SELECT doc_id, "
        + _class_array("sum(s{c}) AS t{c}", classes)
        + " FROM doc_tokens JOIN scores USING (token) GROUP BY doc_id",
        "logits": "SELECT p.doc_id, p.label, p.split, "
        + _class_array(
            "round((SELECT prior FROM mass WHERE label = {c}) + coalesce(t{c}, 0), 6) AS z{c}",
            classes,
        )
        + " FROM parts p LEFT JOIN sums USING (doc_id)",
        "scored": f"""
            SELECT *, greatest({_class_array('z{c}', classes)}) AS top,
                   CAST(list_position([{_class_array('z{c}', classes)}], top) - 1 AS INTEGER)
                   AS prediction,
                   top + ln({_class_array('exp(z{c} - top)', classes, ' + ')})
                   - [{_class_array('z{c}', classes)}][label + 1] AS nll
            FROM logits""",
        "batched": f"""
            SELECT *, row_number() OVER (PARTITION BY split ORDER BY
                   CASE WHEN split = 'train' THEN md5('7:0:' || doc_id) ELSE '' END, doc_id)
                   - 1 AS position,
                   position // {SIZE} AS batch_id
            FROM scored""",
        "batch_loss": """
            SELECT split, batch_id, count(*) AS n_rows, sum(weight * nll) / sum(weight) AS loss
            FROM batched JOIN weights USING (label) GROUP BY split, batch_id""",
        "batch_hits": """
            SELECT split, batch_id, count(*) AS n_rows,
                   avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS accuracy
            FROM batched GROUP BY split, batch_id""",
        "tallies": """
            SELECT b.batch_id, w.label,
                   count(*) FILTER (b.label = w.label AND b.prediction = w.label) AS tp,
                   count(*) FILTER (b.prediction = w.label) AS predicted,
                   count(*) FILTER (b.label = w.label) AS actual
            FROM batched b, (SELECT label FROM weights) w
            WHERE b.split = 'test' GROUP BY b.batch_id, w.label""",
        "ratios": f"""
            SELECT *, tp / (predicted + {EPS}) AS p, tp / (actual + {EPS}) AS r,
                   2 * (p * r) / (p + r + {EPS}) AS f FROM tallies""",
        "batch_scores": """
            SELECT batch_id, label, tp, predicted, actual, round(p, 2) AS precision,
                   round(r, 2) AS recall, round(f, 2) AS f1 FROM ratios""",
        "every_score": f"""
            SELECT split, batch_id, label, round(p, 2) AS precision, round(r, 2) AS recall, round(f, 2) AS f1
            FROM (SELECT *, tp / (predicted + {EPS}) AS p, tp / (actual + {EPS}) AS r,
                         2 * (p * r) / (p + r + {EPS}) AS f FROM (
                  SELECT b.split, b.batch_id, w.label,
                         count(*) FILTER (b.label = w.label AND b.prediction = w.label) AS tp,
                         count(*) FILTER (b.prediction = w.label) AS predicted,
                         count(*) FILTER (b.label = w.label) AS actual
                  FROM batched b, (SELECT label FROM weights) w
                  WHERE b.split <> 'test' GROUP BY b.split, b.batch_id, w.label))""",
        "totals": """
            SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(predicted) AS BIGINT) AS predicted,
                   CAST(sum(actual) AS BIGINT) AS actual FROM tallies GROUP BY label""",
        "epochs": """
            SELECT split, avg(loss) AS loss, count(*) AS n_batches FROM batch_loss GROUP BY split""",
        "accuracies": """
            SELECT split, avg(accuracy) AS accuracy, count(*) AS n_batches
            FROM batch_hits GROUP BY split""",
    }


def _assemble(select: str, classes: int = 4, flag: str = "quality") -> str:
    """Put the expressions ``select`` depends on in front of it, in order."""
    ctes = _ctes(classes, flag)
    needed, pending = set(), [select]
    while pending:
        for name in re.findall(r"\w+", pending.pop()):
            if name in ctes and name not in needed:
                needed.add(name)
                pending.append(ctes[name])
    if not needed:
        return select
    body = ",\n".join(f"{n} AS ({sql})" for n, sql in ctes.items() if n in needed)
    return f"WITH RECURSIVE {body}\n{select}"


_MEANS = """
    SELECT label, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           round(avg(f1), 6) AS f1 FROM batch_scores GROUP BY label"""
_TEXT = "doc_id, label, text"
_IDS = "array_to_string(token_ids, ' ') AS token_ids"
_MASK = "array_to_string(attention_mask, ' ') AS attention_mask"
_LOGITS = "SELECT doc_id, label, {} FROM logits WHERE split = '{}'"


def oracle_sql() -> dict[str, str]:
    lang = {
        "first_rows": "SELECT * FROM docs ORDER BY doc_id LIMIT 5",
        "point_lookup": "SELECT * FROM docs WHERE doc_id = 42",
        "table_summary": """
            SELECT (SELECT count(*) FROM documents) AS n_rows, position, column_name, type, n_non_null
            FROM (SELECT 0 AS position, 'doc_id' AS column_name, 'bigint' AS type,
                         count(doc_id) AS n_non_null FROM documents
                  UNION ALL SELECT 1, 'lang', 'string', count(lang) FROM documents
                  UNION ALL SELECT 2, 'text', 'string', count(text) FROM documents)""",
        "label_index": """
            SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label
            FROM documents""",
        "label_counts": "SELECT label, count(*) AS n_rows FROM docs GROUP BY label ORDER BY label",
        "label_names": "SELECT DISTINCT label FROM docs ORDER BY label",
        "class_profile": """
            SELECT label, count(*) AS n_raw, count(*) FILTER (nth = 1) AS n_distinct,
                   count(*) FILTER (nth = 1 AND n_tokens NOT BETWEEN 1 AND 5) AS n_clean,
                   round(1 - n_clean / CAST(sum(n_clean) OVER () AS DOUBLE), 9) AS weight
            FROM copies GROUP BY label ORDER BY n_raw DESC, label""",
        "strip_text": f"SELECT doc_id, {_strip('text')} AS text FROM docs",
        "strip_turns": f"""
            SELECT *, {_n_tokens('text')} AS n_tokens
            FROM (SELECT conv_id, turn, {_strip('text')} AS text FROM conversations)""",
        "empty_rows": f"""
            SELECT * FROM (SELECT doc_id, label, {_strip('text')} AS text FROM docs)
            WHERE text = ''""",
        "drop_empty": f"SELECT {_TEXT} FROM stripped",
        "strip_segments": f"SELECT doc_id, part, {_strip('text')} AS text FROM segments",
        "empty_segments": f"""
            SELECT * FROM (SELECT doc_id, part, {_strip('text')} AS text FROM segments) WHERE text = ''""",
        "drop_empty_segments": f"""
            SELECT * FROM (SELECT doc_id, part, {_strip('text')} AS text FROM segments) WHERE text <> ''""",
        "duplicate_rows": f"SELECT {_TEXT} FROM copies WHERE nth > 1",
        "dedup_keep_first": f"SELECT {_TEXT} FROM kept",
        "top_duplicates": f"SELECT {_TEXT} FROM copies WHERE nth > 1 ORDER BY text, doc_id LIMIT 20",
        "copy_groups": """
            SELECT min(doc_id) AS doc_id, label, count(*) AS n_copies FROM copies
            GROUP BY label, text HAVING count(*) > 1""",
        "drop_short": f"SELECT {_TEXT}, n_tokens FROM counted WHERE n_tokens NOT BETWEEN 1 AND 5",
        "drop_by_ids": """
            SELECT doc_id, label FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "cleaned_corpus": f"SELECT {_TEXT}, n_tokens FROM clean",
        "token_counts": "SELECT doc_id, n_tokens FROM counted",
        "length_histogram": """
            SELECT n_tokens, count(*) AS n_rows FROM kept GROUP BY n_tokens
            ORDER BY n_rows DESC, n_tokens""",
        "longest_doc": f"SELECT {_TEXT}, n_tokens FROM kept ORDER BY n_tokens DESC, doc_id LIMIT 1",
        "shortest_doc": f"SELECT {_TEXT}, n_tokens FROM kept ORDER BY n_tokens, doc_id LIMIT 1",
        "rows_by_length": f"SELECT {_TEXT}, n_tokens FROM kept WHERE n_tokens BETWEEN 0 AND 7",
        "first_rows_by_length": f"""
            SELECT {_TEXT}, n_tokens FROM kept WHERE n_tokens BETWEEN 0 AND 7
            QUALIFY row_number() OVER (PARTITION BY n_tokens ORDER BY doc_id) <= 2""",
        "count_by_length": """
            SELECT n_tokens, count(*) AS n_rows FROM kept WHERE n_tokens BETWEEN 0 AND 7
            GROUP BY n_tokens""",
        "row_numbers": """
            SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM kept""",
        "batch_numbers": f"""
            SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) - 1 AS position,
                   position // {SIZE} AS batch_id FROM parts WHERE split = 'test'""",
        "batch_totals": f"""
            SELECT split, count(*) AS n_rows, CAST(ceil(count(*) / {SIZE}) AS BIGINT) AS n_batches,
                   n_batches * 3 AS n_steps FROM parts GROUP BY split""",
        "epoch_shuffle": f"""
            SELECT doc_id, label,
                   row_number() OVER (ORDER BY md5('7:1:' || doc_id), doc_id) - 1 AS position,
                   position // {SIZE} AS batch_id FROM parts WHERE split = 'train'""",
        "stratified_split": f"SELECT {_TEXT}, split FROM parts",
        "split_sizes": "SELECT split, label, count(*) AS n_rows FROM parts GROUP BY split, label",
        "approx_split": """
            SELECT doc_id, label, CASE WHEN
                   CAST('0x' || substring(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0
                   < 0.2 THEN 'test' ELSE 'train' END AS split FROM docs""",
        "class_weights": "SELECT label, n_rows, round(weight, 9) AS weight FROM weights",
        "row_weights": """
            SELECT doc_id, label, round(weight, 9) AS weight
            FROM parts JOIN weights USING (label) WHERE split = 'train'""",
        "words": f"""
            SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words,
                   array_to_string(words, ' ') AS words
            FROM (SELECT doc_id, {_words('text')} AS words FROM documents)""",
        "vocabulary": "SELECT token, id FROM vocab",
        "encode_fixed": f"SELECT doc_id, label, split, n_words, {_IDS}, {_MASK} FROM encoded",
        "encode_large_vocab": f"SELECT doc_id, label, split, n_words, {_IDS}, {_MASK} FROM encoded",
        "truncation_report": """
            SELECT split, label, count(*) AS n_rows, count(*) FILTER (truncated) AS n_truncated,
                   round(avg(CAST(truncated AS INTEGER)), 9) AS share_truncated
            FROM encoded GROUP BY split, label""",
        "encoded_join": f"""
            SELECT e.doc_id, e.label, md5(p.text) AS text_md5, {_IDS},
                   CAST(e.n_real AS INTEGER) AS n_real
            FROM encoded e JOIN parts p USING (doc_id)""",
        "unmatched_ids": """
            SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
                   CASE WHEN d.doc_id IS NULL THEN 'corpus' ELSE 'other' END AS missing_in
            FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
            WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
        "nb_model": "SELECT label, token, n FROM model_tokens",
        "nb_labels": "SELECT label, n_rows FROM weights",
        "nb_resume": "SELECT label, token, n FROM model_tokens",
        "nb_logits": _LOGITS.format("z0, z1, z2, z3", "test"),
        "nb_logits_split": _LOGITS.format("z0, z1, z2, z3", "test"),
        "predictions": "SELECT doc_id, label, prediction FROM scored WHERE split = 'test'",
        "row_loss": "SELECT doc_id, label, round(nll, 6) AS nll FROM scored WHERE split = 'test'",
        "weighted_loss_by_batch": """
            SELECT batch_id, n_rows, round(loss, 6) AS loss FROM batch_loss WHERE split = 'test'""",
        "train_loss_by_batch": """
            SELECT batch_id, n_rows, round(loss, 6) AS loss FROM batch_loss WHERE split = 'train'""",
        "epoch_loss": """
            SELECT round(loss, 6) AS loss, n_batches FROM epochs WHERE split = 'test'""",
        "progress_loss": """
            SELECT batch_id, n_rows, round(loss, 6) AS loss FROM batch_loss
            WHERE split = 'test' AND batch_id % 2 = 0""",
        "batch_metrics": "SELECT * FROM batch_scores",
        "results_table": _MEANS + " ORDER BY label",
        "mean_accuracy": """
            SELECT round(accuracy, 6) AS accuracy, n_batches FROM accuracies WHERE split = 'test'""",
        "predicted_texts": """
            SELECT s.doc_id, s.label, s.prediction, p.text FROM scored s JOIN parts p USING (doc_id)
            WHERE s.split = 'test'""",
        "valid_report": """
            SELECT n_batches, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy
            FROM epochs JOIN accuracies USING (split, n_batches) WHERE split = 'valid'""",
        "text_round_trip": """
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, label, md5(text) AS text_md5
            FROM docs""",
        "text_round_trip_spaces": """
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, label, md5(text) AS text_md5
            FROM docs""",
        "split_round_trip": "SELECT doc_id, label, split FROM parts",
        "empty_array_round_trip": f"""
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position,
                   array_to_string(list_filter(list_transform({_words('text')}, lambda w: length(w)),
                                               lambda n: n > 18), ' ') AS sizes
            FROM documents""",
        "lr_predictions": "SELECT doc_id, label, true AS known FROM parts WHERE split = 'test'",
        "lr_reloaded": "SELECT doc_id, label, true AS same FROM parts WHERE split = 'test'",
        "lr_optimum": "SELECT label, n_rows, true AS at_optimum FROM weights",
        "array_round_trip": f"""
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, {_IDS}, {_MASK}
            FROM encoded""",
        "model_round_trip": _LOGITS.format("z0, z1, z2, z3", "valid"),
        "run_metrics": """
            SELECT 'run' AS run_id, 0 AS epoch, split AS subset, 'loss' AS name,
                   round(loss, 6) AS value FROM epochs WHERE split <> 'test'
            UNION ALL SELECT 'run', 0, split, 'accuracy', round(accuracy, 6)
            FROM accuracies WHERE split <> 'test'
            UNION ALL SELECT 'run', 0, split, 'precision/' || label, round(avg(precision), 6)
            FROM every_score GROUP BY split, label
            UNION ALL SELECT 'run', 0, split, 'recall/' || label, round(avg(recall), 6)
            FROM every_score GROUP BY split, label
            UNION ALL SELECT 'run', 0, split, 'f1/' || label, round(avg(f1), 6)
            FROM every_score GROUP BY split, label""",
        "run_params": f"""
            SELECT 'run' AS run_id, 'num_epochs' AS name, '3' AS value
            UNION ALL SELECT 'run', 'num_classes', CAST(count(*) AS VARCHAR) FROM weights
            UNION ALL SELECT 'run', 'batch_size', '{SIZE}'""",
    }
    quality = {
        "quality_logits": _LOGITS.format("z0, z1", "test"),
        "quality_predictions": "SELECT doc_id, label, prediction FROM scored WHERE split = 'test'",
        "batch_accuracy": """
            SELECT batch_id, n_rows, round(accuracy, 9) AS accuracy
            FROM batch_hits WHERE split = 'test'""",
        "batch_mean_metrics": _MEANS,
        "global_metrics": f"""
            SELECT label, tp, predicted, actual, round(p, 6) AS precision, round(r, 6) AS recall,
                   round(2 * (p * r) / (p + r + {EPS}), 6) AS f1
            FROM (SELECT *, tp / (predicted + {EPS}) AS p, tp / (actual + {EPS}) AS r FROM totals)""",
        "shifted_labels": """
            SELECT doc_id, label + 5 AS label, prediction + 5 AS prediction, round(nll, 6) AS nll
            FROM scored WHERE split = 'test'""",
    }
    wrong = """
        SELECT s.doc_id, s.label, s.prediction, p.text FROM scored s JOIN parts p USING (doc_id)
        WHERE s.split = 'test' AND s.label <> s.prediction"""
    toxic = {"error_rows": wrong, "first_error_rows": f"{wrong} ORDER BY s.doc_id LIMIT 5"}
    out = {name: _assemble(sql) for name, sql in lang.items()}
    out.update({name: _assemble(sql, classes=2) for name, sql in quality.items()})
    out.update({name: _assemble(sql, classes=2, flag="toxic") for name, sql in toxic.items()})
    # Every distinct word of the cleaned corpus, not only those an encoding reaches.
    whole = "SELECT DISTINCT unnest(words) AS word FROM worded"
    out["word_pieces"] = _assemble("SELECT word, array_to_string(ids, ' ') AS ids FROM pieces").replace(
        _ctes(4)["lexicon"], whole
    )
    out["word_pieces_by_join"] = out["word_pieces"]
    return out
