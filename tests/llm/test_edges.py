"""Components near the ends of the range of doubles, and tokenizers files with other features."""

import json

import pytest

from zonalis.llm import bpe, embedding_dedup


def test_vectors_of_any_size_compare(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(k, [x * f for x in base]) for k, f in enumerate((1.0, 1e200, 1e-200, 1e307, 1e-300))] + [(9, [-3.0e200, 1.0e200, 2.0e200, 5.0e200])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k]["n_links"] for k in range(5)] == [4] * 5 and got[9]["n_links"] == 0 and {got[k]["component_id"] for k in range(5)} == {0}


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}])
def test_other_tokenizers_files_are_refused(tmp_path, change):
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        bpe.Codec(str(path))
