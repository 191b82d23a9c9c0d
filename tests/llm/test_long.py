"""One text or page of 20 MB through each operator's own code, in a process of its own: time and memory."""

import subprocess
import sys

import pytest

CODE = """
import resource, sys, pyarrow as pa
from tests.llm.helpers import prose
lines = [prose(i, 4000) for i in range(50)]
text = "\\n".join(lines * (20_000_000 // sum(map(len, lines)) + 1))[:20_000_000]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{0}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
CASES = {
    "op2": """
from zonewright.llm import suffixes
import numpy as np
data, at = suffixes.flat(pa.array([text]))
pieces = [*suffixes._pieces(at)]
starts = 0
for lo, hi, skip, stop in pieces:
    _, a, b, _ = suffixes.anchors(data[skip:stop], np.array([0, stop - skip]))
    starts += int((b - a + 1).sum())
assert len(pieces) > 5 and starts == len(data) - suffixes.LENGTH + 1
""",
    "op3": """
from zonewright.llm import quality
assert quality.measure(text, quality.Compression())[0] > 1_000_000
""",
    "op4": """
from zonewright.llm import minhash
assert len(minhash.to_hex(minhash.signatures(pa.array([text])))[0]) == 4 * minhash.PERMUTATIONS
""",
    "op5": """
from zonewright.llm import html
source = "<body><nav>x</nav><article>" + "".join(f"<p>{t}</p>" for t in text.split("\\n")) + "</article></body>"
page = html.Page(source)
assert page.extract([page.path(page.container()[0])]) == " ".join(text.split())
""",
    "op6": """
import public_tokenizers, numpy as np
from zonewright.llm import bpe
tokenizer = bpe.Tokenizer.load(public_tokenizers.path(bpe.TOKENIZER))
n = sum(map(len, tokenizer.stream(text)))
assert n > 5_000_000 and sum(map(len, tokenizer.stream(text[:400_000].replace(" ", "").replace("\\n", "")))) > 50_000
""",
    "op7": """
from zonewright.llm import toxicity
texts = ["good words " * 5, "idiot scum " * 5] * 20
model = toxicity.train(texts, [0, 1] * 20)
model.weights[:] = 1e-6  # all buckets are used
assert 0 <= model.scores(pa.array([text]))[0] <= 1
_, _, count, grams = toxicity.presence(pa.array([text]))
assert count.sum() == grams[0]
""",
    "op8": """
from zonewright.llm import simhash
assert simhash.fingerprint(text)
""",
    "op9": """
from zonewright.llm import language
model = language.train([("the and of " * 9, "en"), ("der die das " * 9, "de")])
assert model.predict(text)[0] in ("en", "de")
assert model.predict("derdie" * 500_000 + "theand" * 100)[0] == "de"
""",
}


@pytest.mark.parametrize("case", CASES)
def test_a_long_text(case):
    run = subprocess.run([sys.executable, "-c", CODE.format(CASES[case])], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout) < 1000, f"{run.stdout} MB"
