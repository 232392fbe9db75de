"""Training tables and corpus error rate."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segmark import fixtures as fx
from segmark.operators import dataset as ds
from segmark.session import cut_folder
from segmark.suite import query

_T = fx.with_views("training")

_VOCAB = """
    toks as (select distinct tok from (select unnest(regexp_split_to_array(phonemes, '\\s+')) as tok from training) where tok <> ''),
    ranked as (select tok as token, (row_number() over (order by encode(tok)) - 1)::int as id from toks),
    vocab as (select * from ranked
              union all select '[UNK]', count(*)::int from ranked
              union all select '[PAD]', count(*)::int + 1 from ranked)"""


@query(
    "q_training_rows",
    _T
    + """
    select row_idx, 'clips/' || path as audio, phonemes, input_length from training where trim(phonemes) <> ''""",
)
def q_training_rows(spark, sf_dir):
    return ds.training_rows(fx.training_rows(spark, sf_dir), "clips")


@query("q_vocab", _T + "," + _VOCAB + " select * from vocab")
def q_vocab(spark, sf_dir):
    return ds.build_vocab(fx.training_rows(spark, sf_dir))


# Vocabulary of user turns only, so that other turns hold unknown tokens.
_USER_VOCAB = """
    ut as (select unnest(regexp_split_to_array(text, '\\s+')) as tok from conversations where role = 'user'),
    ranked as (select tok as token, (row_number() over (order by encode(tok)) - 1)::int as id
               from (select distinct tok from ut where tok <> '')),
    n as (select count(*)::int as n from ranked),
    enc as (select row_idx, k, coalesce(r.id, (select n from n)) as id
            from (select row_idx, unnest(a) as tok, unnest(range(0, len(a))) as k
                  from (select row_idx, regexp_split_to_array(phonemes, '\\s+') as a from training))
            left join ranked r on r.token = tok where tok <> '')"""


def _user_vocab(spark, sf_dir):
    users = fx.table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return ds.build_vocab(users.select(F.col("text").alias("phonemes")))


def _encoded(spark, sf_dir):
    return ds.encode_labels(fx.training_rows(spark, sf_dir), _user_vocab(spark, sf_dir))


@query(
    "q_encode_labels",
    _T + "," + _USER_VOCAB + " select row_idx, string_agg(id::varchar, ' ' order by k) as labels from enc group by row_idx",
)
def q_encode_labels(spark, sf_dir):
    return _encoded(spark, sf_dir).select(
        "row_idx", F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels")
    )


@query(
    "q_duration_filter",
    _T + " select row_idx, path, input_length from training where input_length > 16000 and input_length < 480000",
)
def q_duration_filter(spark, sf_dir):
    return ds.filter_by_length(fx.training_rows(spark, sf_dir)).select("row_idx", "path", "input_length")


@query("q_head_rows", _T + " select row_idx, path from training where row_idx < 100")
def q_head_rows(spark, sf_dir):
    return ds.head_rows(fx.training_rows(spark, sf_dir), 100).select("row_idx", "path")


@query(
    "q_chunk_assignment",
    _T
    + """ select (row_idx // 50)::int as chunk_id, row_idx, path from training
          where input_length > 16000 and input_length < 480000""",
)
def q_chunk_assignment(spark, sf_dir):
    path = f"{cut_folder(spark)}/chunks-{uuid.uuid4().hex}"
    rows = fx.training_rows(spark, sf_dir)
    ds.write_chunks(rows, path, 50)
    ds.write_chunks(rows, path, 50)  # a second run finds every chunk done
    return ds.read_chunks(spark, path).select(F.col("chunk_id").cast("int").alias("chunk_id"), "row_idx", "path")


@query(
    "q_vocab_size",
    _T
    + ","
    + _USER_VOCAB
    + """ select greatest(max(id), 0)::int as observed_max, greatest(max(id), (select n + 1 from n))::int + 1 as vocab_size
          from enc""",
)
def q_vocab_size(spark, sf_dir):
    return ds.vocab_size(_user_vocab(spark, sf_dir), _encoded(spark, sf_dir))


# Predicted classes per chunk against the labels heard two chunks earlier: five classes, one ASCII letter each.
_PRED = """
    tok as (select utt, chunk, frame, list_position(logits, list_max(logits)) - 1 as token from frames),
    seq as (select utt, chunk, list(token order by frame) as ids from tok group by utt, chunk),
    pred as (select a.utt, a.chunk, a.ids as h, b.ids as r from seq a join seq b on a.utt = b.utt and a.chunk = b.chunk + 1),
    txt as (select list_reduce(list_prepend('', list_transform(list_filter(range(1, len(h) + 1), lambda i:
                     (i = 1 or h[i] <> h[greatest(i - 1, 1)]) and h[i] <> 0), lambda i: chr((97 + h[i])::int))), lambda x, y: x || y) as ht,
                   list_reduce(list_prepend('', list_transform(list_filter(r, lambda x: x not in (0, 7)), lambda x: chr((97 + x)::int))),
                               lambda x, y: x || y) as rt from pred)"""


@query(
    "q_corpus_per",
    fx.with_views("frames")
    + ","
    + _PRED
    + """ select round(coalesce(sum(levenshtein(rt, ht))::double / sum(length(rt)), 1.0), 9) as per
          from txt where length(rt) > 0""",
)
def q_corpus_per(spark, sf_dir):
    from segmark.operators.frames import best_tokens

    tokens = best_tokens(fx.frames(spark, sf_dir))
    ids = F.sort_array(F.collect_list(F.struct("frame", "token")))["token"]
    seq = tokens.groupBy("utt", "chunk").agg(ids.alias("ids"))
    heard = seq.select("utt", "chunk", F.col("ids").alias("predicted"))
    # Class 7 of the labels stands for positions a training batch ignores.
    said = seq.select(
        "utt",
        (F.col("chunk") + 1).alias("chunk"),
        F.transform("ids", lambda x: F.when(x == 7, ds.IGNORED_LABEL).otherwise(x)).alias("labels"),
    )
    per = ds.corpus_error_rate(heard.join(said, ["utt", "chunk"]), pad_id=0)
    return per.select(F.round("per", 9).alias("per"))
