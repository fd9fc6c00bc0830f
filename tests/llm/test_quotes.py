import re

from tallyrail.llm import quotes


def normal(line):
    return " ".join(re.sub(r"[\W_]+", " ", line.lower()).split())


def brute(rows):
    """(conv, turn) -> reply_to, root, position, n_quoted, own text; by plain loops over all earlier messages."""
    parsed = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        lines = []
        for line in re.split(r"\r\n|\r|\n", text or ""):
            m = re.match(quotes.MARKS, line)
            lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
        parsed[k] = lines
    wanted = lambda k, level: {normal(b) for lv, b in parsed[k] if lv == level and len(normal(b).split()) >= 3}
    reply = {}
    for k, (conv, turn, *_) in enumerate(rows):
        votes = {}
        for line in wanted(k, 1):
            authors = [t for j, (c, t, *_) in enumerate(rows) if c == conv and t is not None and turn is not None and t < turn and line in wanted(j, 0)]
            if authors:
                votes[max(authors)] = votes.get(max(authors), 0) + 1
        if votes:
            reply[conv, turn] = max(votes, key=lambda t: (votes[t], t))
    out = []
    for k, (conv, turn, role, _) in enumerate(rows):
        root = turn
        while (conv, root) in reply:
            root = reply[conv, root]
        own = "\n".join(b for lv, b in parsed[k] if lv == 0 and not re.match(r"(?i)^on .{1,200} wrote:$", b.strip()))
        own = re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "", own)
        out.append((conv, turn, role, reply.get((conv, turn)), root, sum(lv > 0 for lv, _ in parsed[k]), own))
    return out


ROWS = [
    (1, 0, "user", "Hello there my friend\nHow are you today?"),
    (1, 1, "assistant", "On Monday someone wrote:\n> How are you TODAY\n\nVery well thank you indeed\n"),
    (1, 2, "user", ">> How are you today?\n> Very well, thank you indeed\nGood to hear that news"),
    (1, 3, "user", "> hello there my friend!\r\nA second answer to this"),
    (1, 4, "user", "> never said by anyone\nNo link here at all"),
    (1, 5, "assistant", "> > nested only here now\n"),
    (1, 5, "assistant", "> > nested only here now\n"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, None, "user", "> Hello there my friend"),
    (None, 0, "user", "words of nobody here"),
    (None, 1, None, "> words of nobody here"),
    (3, 0, "user", "same line every time"),
    *[(3, k, "user", "> same line every time\nsame line every time") for k in range(1, 40)],
]


def test_against_brute_force(spark):
    messages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, root string, position int")
    got = quotes.link_quotations(messages).collect()
    columns = ("conv_id", "turn", "role", "reply_to", "root", "n_quoted", "text")
    assert sorted([tuple(r[c] for c in columns) for r in got], key=repr) == sorted(brute(ROWS), key=repr)
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        keys = [(r.root is not None, r.root, r.turn) for r in own if r.turn is not None]
        assert keys == sorted(keys)


def test_empty_table(spark):
    assert quotes.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_without_quotations_keep_their_order(spark, small):
    got = quotes.op4_quotation_linking(spark, small).collect()
    assert got and all(r.root == r.turn == r.position and r.reply_to is None for r in got)


def test_passages_levels_short_ones_and_scripts_without_spaces(spark):
    rows = [
        (1, 0, "The first of all messages says a good deal\nabout nothing in particular, and ends here."),
        (1, 1, "> The first of all\n> messages says a good deal about nothing\n> in particular, and ends here.\nRewrapped above"),
        (1, 2, ">> about nothing in particular, and ends here.\nOnly nested above"),
        (2, 0, "Yes, please"),
        (2, 1, "Something else entirely"),
        (2, 2, "> Yes, please\nThank you"),
        (2, 3, "> Yes,\n> please\nOnce more"),
        (2, 4, "> No, thanks\nNobody said that"),
        (3, 0, "\u4eca\u65e5\u306f\u3068\u3066\u3082\u3044\u3044\u5929\u6c17\u3067\u3059\u306d"),
        (3, 1, "> \u4eca\u65e5\u306f\u3068\u3066\u3082\n> \u3044\u3044\u5929\u6c17\u3067\u3059\u306d\n\u306f\u3044"),
    ]
    messages = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.root, r.n_quoted, r.n_linked) for r in quotes.link_quotations(messages).collect()}
    assert got[1, 1] == (0, 0, 3, 3) and got[1, 2] == (0, 0, 1, 1)
    assert got[2, 2] == (0, 0, 1, 1) and got[2, 3] == (0, 0, 2, 2) and got[2, 4] == (None, 4, 1, 0)
    assert got[3, 1] == (0, 0, 2, 2)
