"""Invented prose."""

WORDS = "the of and to in that is was for on with by from anthe thion ering estor ntha lyer ouse bletion wheres haaning tioner erst shing onder".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "er", "ing", "ly", "th"]) for _ in range(n))
