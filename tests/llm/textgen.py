WORDS = "the of and river stone light under bridge garden market window silver letter winter summer ocean forest quiet paper engine".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))
