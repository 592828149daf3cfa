"""Every registered query against its SQL counterpart."""

import pytest

from checks import registry
from checks.compare import compare

registry.load()

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# the published split needs 600 rows per class, which the smallest tables lack
NEEDS_SPLIT = {"prompt_frames", "join_semi_known", "join_anti_rest", "split_stratified",
               "sample_with_replacement", "union_class_parts", "except_used", "augment_train",
               "clean_and_pert_test", "clean_pert_pairs", "train_classifier",
               "train_classifier_rows"}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, databases, name):
    sf = MEDIUM if name in NEEDS_SPLIT else SMALL
    out = compare(spark, databases[sf], sf, name)
    assert out.startswith(("ok", "rows")), out


def test_every_query_but_the_known_ones_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"train_classifier"}
