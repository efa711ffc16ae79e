import random

from polyglint.operators import speakers

NAMES = ["一歌", "咲希", "みのり", "杏", "ミク", "杏", "のの"]
MODELS = {1: 4, 2: 0}


def by_hand(speaker, model):
    def prefix(text):
        return next((i for i, n in enumerate(NAMES) if text == n or text.startswith(n + "の")), None)

    if not speaker or not speaker.strip("？?"):
        return None, None
    if speaker in NAMES:
        return NAMES.index(speaker), "exact"
    if model in MODELS:
        return MODELS[model], "model"
    for mark in "・＆":
        found = [i for i in map(prefix, speaker.split(mark)) if i is not None] if mark in speaker else []
        if found:
            return found[0], "part"
    return (prefix(speaker), "prefix") if prefix(speaker) is not None else (None, None)


def test_speakers_are_resolved_by_the_first_rule_that_finds_one(spark):
    r = random.Random(8)
    pieces = [*NAMES, "の", "・", "＆", "母", "？", "?", "A", ""]
    rows = [("".join(r.choice(pieces) for _ in range(r.randrange(1, 6))), r.choice([1, 2, 3, None])) for _ in range(1500)]
    rows += [(None, 1), ("", 1), ("？?", 1), ("一歌の母＆咲希", None), ("母・ミクの声＆杏", 3), ("母・父＆みのりの友", 3), ("のののの", 3)] + [("杏の友", 9)] * 3
    rows += [("杏の友の母・" * 3000, None)]
    lines = spark.createDataFrame([(n, s, m, 7) for n, (s, m) in enumerate(rows)], "n long, speaker string, model int, index int")
    characters = spark.createDataFrame(list(enumerate(NAMES)), "index int, name string")
    models = spark.createDataFrame([*MODELS.items(), (1, 5)], "model int, index int")
    got = {x.n: (x["index"], x["rule"]) for x in speakers.resolved(lines, characters, models).collect()}
    assert got == {n: by_hand(s, m) for n, (s, m) in enumerate(rows)}
    assert {rule for _, rule in got.values()} == {*speakers.RULES, None}
    assert speakers.resolved(lines.limit(0), characters, models).count() == 0
    assert {x.rule for x in speakers.resolved(lines.where("speaker = '杏'"), characters.limit(0), models.limit(0)).collect()} == {None}
