"""The classifier's filters: texts that only the order of two words tells apart."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import words

from sitegauge.llm import toxicity as tox
from sitegauge.llm.common import word_hashes


@pytest.fixture(scope="module")
def planted():
    """Toxic texts hold "quarrel velvet", the others "velvet quarrel": no word tells anything by itself."""
    r, vocabulary = random.Random(1), words(1, 60)
    label, texts = np.array([i % 2 for i in range(1600)]), []
    for toxic in label:
        text = [r.choice(vocabulary) for _ in range(r.randint(6, 14))]
        at = r.randrange(len(text) - 1)
        text[at:at] = ["quarrel", "velvet"] if toxic else ["velvet", "quarrel"]
        texts.append(" ".join(text))
    hashes, where = word_hashes(pa.array(texts), tox.PREFIXES)
    ids = tox.buckets(hashes)
    return [ids[where[i] : where[i + 1]] for i in range(len(texts))], label


def accuracy(planted, epochs):
    """Of the best cut on rows that training has not seen."""
    ids, label = planted
    model = tox.train(ids[:1200], label[:1200], np.zeros(1200, int), epochs=epochs)
    raw = np.array([model.raw(np.concatenate([tox.NONE, x]), np.array([0, len(x)]))[0] for x in ids[1200:]])
    return max(((raw > cut) == label[1200:]).mean() for cut in np.quantile(raw, np.linspace(0.02, 0.98, 49)))


def test_training_learns_what_the_start_can_not_tell(planted):
    start, trained = accuracy(planted, 0), accuracy(planted, 8)
    assert start < 0.65 and trained >= 0.9, (start, trained)
