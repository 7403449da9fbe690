"""Addresses and weak parts against the patterns as they read, and in time proportional to the text."""

import random
import re
import time

import pytest

from cellweave.llm.secrets import endpoints, strong_spans, weak_parts

PLAIN = re.compile(r"(?:\b[a-z][a-z0-9+.-]{1,11}://[^\s\"'<>]+)|(?:\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b(?::[0-9]{2,5})?)|(?:\b[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b)", re.ASCII)


def test_as_the_pattern_reads():
    rnd = random.Random(3)
    bits = ["db", "x-1", ".", ".", "..", ":", ":80", ":5432", ":123456", " ", "A", "_", "-", "1.2.3.4", "10.0.0.1:22", "http://", "ab://h.i:80/p", "é", '"', "host.example.com:443", "9"]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 9)))
        assert endpoints(text) == [m.span() for m in PLAIN.finditer(text)], text


@pytest.mark.parametrize("unit", ["a.", "a-", "a.b:80 ", "a..b:80", "1.", ":80", "token=x1 ", "AKIA" + "Q" * 20 + " h.i:80 password=abc ", "a.:80"])
def test_time_is_proportional(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.time()
    weak_parts(text, strong_spans(text))
    assert time.time() - began < 5
