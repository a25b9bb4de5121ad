import re

from crawlscape.llm import licenses


def test_base_places_equal_brute_force(edge, nothing, spark):
    texts = ["Apache License apache license, CC BY cc by-sa MIT  license", "gnu General\nPublic license", "cc", "cc by cc by", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(edge.select("doc_id", "text"))
    wanted = []
    for r in rows.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = sorted((i, lab) for p, lab in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        wanted.append((r.doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    got = licenses.scan_licenses(rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(wanted, key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan_licenses(nothing).count() == 0


def template(label):
    return next(t for n, t in licenses.TEMPLATES if n == label)


def labels_of(text):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES)
    return [n for n, _, _ in scanner.attributed(scanner.scan(licenses.words_of(text))[1])]


def test_chains_find_edited_templates():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES)
    words = licenses.words_of("intro words " + template("bsd").replace("without modification", "without any modification") + " outro")
    cover, first, last = scanner.scan(words)[1][licenses.TEMPLATES.index(("bsd", template("bsd")))][0]
    assert cover > 0.9 and first == 2 and last == len(words) - 2
    assert not scanner.scan(licenses.words_of("is the of and in the to " * 50))[1]


def test_related_licences_are_told_apart():
    assert len({n for n, _ in licenses.TEMPLATES}) >= 30
    for name, text in licenses.TEMPLATES:
        assert name in labels_of("before it " + text + " after it"), name
    for name in ("gpl", "lgpl", "agpl", "cc-by", "cc-by-sa", "cc-by-nc-nd", "isc", "0bsd"):
        assert labels_of(template(name)) == [name]
    assert labels_of((template("zlib") + " some words between ") * 3) == ["zlib"] * 3


def test_a_run_of_one_template_within_another_is_seen():
    templates = [("a", "one two three four five six seven"), ("b", "three four five six seven eight nine ten")]
    chains = licenses.Scanner(templates, {}).scan(licenses.words_of("two three four five six seven x eight nine ten"))[1]
    assert chains[1][0] == (1.0, 1, 9) and chains[0][0] == (6 / 7, 0, 5)


def brute_matches(words, text):
    found = []
    for i in range(len(words)):
        for p in range(len(text)):
            if words[i] == text[p] and (i == 0 or p == 0 or words[i - 1] != text[p - 1]):
                n = 0
                while i + n < len(words) and p + n < len(text) and words[i + n] == text[p + n]:
                    n += 1
                if n >= licenses.MIN_RUN:
                    found.append((i, p, n))
    return sorted(found)


def brute_cover(runs):
    """The most words that an ordered chain of runs covers, over all predecessors."""
    best: list = []
    runs = sorted(runs, key=lambda r: (r[0] + r[2], r[1] + r[2]))
    for i, (start, p, n) in enumerate(runs):
        own = n
        for j in range(i):
            de, te = runs[j][0] + runs[j][2], runs[j][1] + runs[j][2]
            lap = max(0, de - start, te - p)
            if lap < n and start - de <= licenses.MAX_GAP and p - te <= licenses.MAX_GAP:
                own = max(own, best[j] + n - lap)
        best.append(own)
    return max(best, default=0)


def test_matches_and_chains_equal_brute_force():
    import random

    rng = random.Random(12)
    for _ in range(150):
        letters = [f"w{i}" for i in range(rng.choice([2, 4, 9]))]
        templates = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randrange(1, 25)))) for k in range(rng.randrange(1, 5))]
        words = licenses.words_of(" ".join(rng.choice([*letters, "other"]) for _ in range(rng.randrange(0, 60))))
        scanner = licenses.Scanner(templates, {"w0 w1": "base"})
        found = scanner.matches(words)[1]
        chains = scanner.scan(words)[1]
        for k, (_, text) in enumerate(templates):
            wanted = brute_matches(words, licenses.words_of(text))
            assert sorted(found[k]) == wanted
            cover = brute_cover(wanted) / len(licenses.words_of(text))
            assert (chains[k][0][0] if k in chains else 0) == cover and cover <= 1


def test_added_labels_and_score_equal_a_plain_scan(edge):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES)
    for r in licenses.scan_licenses(edge.select("doc_id", "text", "lang"), keep=("doc_id", "text")).collect():
        words = licenses.words_of(r.text)
        covers = [brute_cover(brute_matches(words, licenses.words_of(t))) / len(licenses.words_of(t)) for _, t in licenses.TEMPLATES] if len(words) < 100 else [0]
        assert r.score == (1.0 if r.n_base else max(covers))
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | set(n for n, _, _ in scanner.attributed(scanner.scan(words)[1]))


def test_automaton_knows_every_substring():
    sam = licenses.SuffixAutomaton([[1, 2, 1, 3], [2, 1, 2], [3]])
    subs = {tuple(s[i:j]) for s in ([1, 2, 1, 3], [2, 1, 2], [3]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}

    def known(t):
        at = 0
        for x in t:
            if x not in sam.next[at]:
                return False
            at = sam.next[at][x]
        return True

    from itertools import product

    assert all(known(t) == (t in subs) for n in range(1, 5) for t in product((1, 2, 3), repeat=n))
