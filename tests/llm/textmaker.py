"""Invented prose for the tests."""

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def word(rng):
    return "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))


def prose(rng, n):
    out = []
    for k in range(n):
        w = word(rng)
        out.append((w.capitalize() if k % 11 == 0 else w) + ("." if k % 11 == 10 else ""))
        if k % 23 == 22:
            out[-1] += "\n"
    return " ".join(out)
