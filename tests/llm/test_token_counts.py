"""The token count query against a plain loop, with repeated ids."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from parley.llm import catalog

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_op3_equals_a_loop(spark, tmp_path):
    docs = [
        (1, "one line\none line\nanother", "en", "web"), (1, "same id\nsame id\nsame id\nother text", "en", "web"),
        (1, "third\nthird", None, "web"), (2, "poor and toxic\npoor and toxic", "en", "web"), (3, "kept\nkept", "de", "book"),
        (4, None, "de", "book"), (5, "toxic", "de", "book"), (None, "no id\nno id", "de", "book"),
    ]
    labels = [(1, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 0, 0), (5, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    library = Tokenizer.from_file(PATH)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    toxic = {i for i, _, bad in labels if bad}
    poor = {i for i, q, _ in labels if not q} - toxic
    want: Counter = Counter()
    n_docs: Counter = Counter()
    for i, t, lang, source in docs:
        if i not in toxic:
            want[source, lang] += size("\n".join(dict.fromkeys((t or "").split("\n"))) if i in poor else t)
            n_docs[source, lang] += 1
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in catalog.op3_token_counts(spark, str(tmp_path)).collect()}
    assert got == {k: (n_docs[k], want[k]) for k in n_docs}
