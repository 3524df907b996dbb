"""Secrets in long runs that look like one and fail."""

import random
import time

import pytest

from recordmill.llm import secrets as S

PARTS = ["eyJ", "eyJa", ".", "_", "abcdefgh", "token", "=", ": ", "'", "AKIA", "Z9", "deadbeef", "://", "http", "@", ":", "-----BEGIN ", "PRIVATE KEY-----",
         "-----END ", "\n", " ", "xoxb-", "ghp_", "AIza", "0123456789", "é"]


@pytest.mark.parametrize("long_run", [-2, 0, 5])
def test_all_starts_at_once_equal_one_by_one(monkeypatch, long_run):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choices(PARTS[:6], k=40)) for _ in range(300)]
    texts += ["".join(rng.choices(["http", "://", "ab", ":", "@", "x"], k=20)) for _ in range(300)]
    monkeypatch.setattr(S, "LONG_RUN", 1 << 40)
    plain = [S.find(t) for t in texts]
    monkeypatch.setattr(S, "LONG_RUN", long_run)
    assert [S.find(t) for t in texts] == plain
    assert {kind for found in plain for kind, _, _ in found} >= {"assign", "hex", "web_token", "url_login", "private_key"}


def test_time_follows_the_length():
    """Four times the run takes about four times as long, not sixteen, and a secret behind it is found."""
    def seconds(n):
        text = "." + "eyJa" * n + " eyJabcdefgh.eyJabcdefgh.abcdefgh"
        begun = time.process_time()
        assert [(k, b - a) for k, a, b in S.find(text)] == [("web_token", 32)]
        return time.process_time() - begun

    seconds(100)
    assert seconds(40_000) < 9 * seconds(10_000)
