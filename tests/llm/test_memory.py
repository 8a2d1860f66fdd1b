"""Workers that wait for other tasks give back memory."""

from convolens.llm import shared


def test_batches_pass_and_memory_is_given_back_at_the_end(monkeypatch):
    done = []
    monkeypatch.setattr(shared.gc, "collect", lambda: done.append("end"))

    def run(batches):
        for b in batches:
            assert not done
            yield b * 2

    assert list(shared.given_back(run)(iter([1, 2, 3]))) == [2, 4, 6]
    assert done == ["end"]
    assert shared.given_back(run).__wrapped__ is run
