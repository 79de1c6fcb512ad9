"""Secret literals in typed, chained, back-tick, spaced and short forms."""

import random
import string
import time

import pytest

from lapsegrid.llm import secrets


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('API_SECRET: str = "Zx9!kQ2#vT7pLm4w"', "Zx9!kQ2#vT7pLm4w"),
        ('let apiToken: string = "Zx9kQ2vT7pLm4wAB";', "Zx9kQ2vT7pLm4wAB"),
        ('token: Optional[str] = "Zx9!kQ2#vT7pLm4w"', "Zx9!kQ2#vT7pLm4w"),
        ("token: str | None = 'Zx9!kQ2#vT7pLm4w'", "Zx9!kQ2#vT7pLm4w"),
        ("apiToken?: string = `Zx9!kQ2#vT7pLm4w`", "Zx9!kQ2#vT7pLm4w"),
        ('let token: &\'static str = "Zx9!kQ2#vT7pLm4w";', "Zx9!kQ2#vT7pLm4w"),
        ('token = alias = "Zx9!kQ2#vT7pLm4w"', "Zx9!kQ2#vT7pLm4w"),
        ('token=alias=other="Zx9!kQ2#vT7pLm4w"', "Zx9!kQ2#vT7pLm4w"),
        ("const signingKey = `Zx9!kQ2#vT7pLm4w`", "Zx9!kQ2#vT7pLm4w"),
        ('pwd = "Xk9!mP2q"', "Xk9!mP2q"),
        ('pwd = "Xk9! mP2q vT7#"', "Xk9! mP2q vT7#"),
    ],
)
def test_literal_is_found_and_redacted(text, literal):
    assert (text.index(literal), 3, text.index(literal) + len(literal)) in secrets.spans_of(text)[1]
    assert literal not in secrets.redact(text)


@pytest.mark.parametrize(
    "text",
    [
        "auth_token: string", "def f(auth_token: str = None): pass", "private_key = self.key", 'pwd_hint = "Please enter your password"', 'title = `Zx9!kQ2#vT7pLm4w`',
        "authKey = authKey1\nauthKey1 = other", "pwd = alias == other",
    ],
)
def test_names_types_and_prose_are_no_literals(text):
    assert [s for s in secrets.lexed_spans(text)] == []


def test_bare_literals_stay_whole():
    for text in ("signing_key: Zx9kQ2vT7pLm4wAB= and so on", "signing_key=Zx9kQ2vT7pLm4wAB==", "signing_key: Zx9kQ2vT7pLm4wAB = x"):
        found = [text[a:b].rstrip("=") for a, _, b in secrets.lexed_spans(text)]
        assert found == ["Zx9kQ2vT7pLm4wAB"]


def test_lexing_takes_linear_time():
    for text in ("a=" * 200_000, "a:a[" * 100_000, "a = " * 100_000, "a: b | " * 50_000, "a:a::" * 60_000, "k: `" * 60_000):
        secrets.lexed_spans(text)


def planted(rnd, literal):
    """A text with the literal under a sensitive name in one of many forms, and the pieces that must be found."""
    half = len(literal) // 2
    a, b = literal[:half], literal[half:]
    name = rnd.choice(["auth_token", "dbPassword", "SIGNING_KEY", "clientSecret", "private_key", "session-secret", "api_secret"])
    word = name.replace("-", "_")
    return rnd.choice([
        (f'{word} = "{literal}"', [literal]),
        (f"{name}: {literal}", [literal]),
        (f'x1 = "{a}" + "{b}"\n{word} = x1', [a, b]),
        (f'p1 = "{a}"\np2 = "{b}"\n{word} = p1 + p2', [a, b]),
        (f'{word} = ("{a}"  # left\n    "{b}")', [a, b]),
        (f'{word} = "{a}" \\\n  "{b}"', [a, b]),
        (f"{name}: |\n  {a}\n  {b}\nnext: 1", [f"{a}\n  {b}"]),
        (f'{word}: str = "{literal}"', [literal]),
        (f"let {word}: string = `{literal}`;", [literal]),
        (f"{word} = alias = '{literal}'", [literal]),
        (f"credentials:\n  main: {literal}", [literal]),
        ('{"' + word + '": {"value": "' + literal + '"}}', [literal]),
        (f"[secrets]\nmain = {literal}", [literal]),
        (f"- name: {word}\n  value: {literal}", [literal]),
        (f"<{word}>{literal}</{word}>", [literal]),
        (f"export {word}={literal}", [literal]),
        (f"{word}=$(cat <<END\n{literal}\nEND\n)", [literal]),
        (f'$v = "{a}" . "{b}";\n${word} = $v;', [a, b]),
        (f'String v = "{a}" +\n   "{b}";\nString {word} = v;', [a, b]),
        (f'{word} = decode("{literal}")', [literal]),
        (f'later = "{literal}"\nq = 1\n{word} = later\nlater = "something else entirely"', [literal]),
    ])


def test_recall_of_planted_assignments():
    rnd = random.Random(9)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    prose = "A note on the way it was done. It took long: two days, at least. See the list (below) for more = less.\n"
    total = found = wrong = 0
    missed = set()
    for _ in range(1500):
        literal = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(16, 40)))
        text, pieces = planted(rnd, literal)
        text = prose + text + "\n" + prose
        spans = secrets.spans_of(text)[1]
        for piece in pieces:
            a = text.index(piece)
            total += 1
            hit = any(s <= a and a + len(piece) <= e for s, _, e in spans)
            found += hit
            if not hit:
                missed.add(text.replace(prose, ""))
        wrong += sum(text[s:e] not in pieces for s, k, e in spans if k == 3)
    assert found >= 0.98 * total and wrong <= 0.01 * total, (found, total, wrong, sorted(missed)[:5])


def plain_run(lines):
    """Spans of the literals that the sensitive names of a program of ``name = a + "b" + ...`` lines stand for."""
    bound, out, at = {}, set(), 0
    for name, terms in lines:
        at += len(name) + 3
        value = []
        for k, t in enumerate(terms):
            at += 3 if k else 0
            if t.startswith('"'):
                value.append((at + 1, at + len(t) - 1, t[1:-1]))
            else:
                value += bound[t]
            at += len(t)
        at += 1
        bound[name] = value
        weight, folded = secrets.sensitivity(name), "".join(x for _, _, x in value)
        if weight >= 2 and secrets.enough(weight, folded, True):
            out.update((a, b) for a, b, _ in value)
    return out


def test_propagation_against_a_plain_interpreter():
    rnd = random.Random(10)
    names = ["a", "b", "c", "title", "auth_token", "signing_key", "dbSecret"]
    hits = 0
    for _ in range(400):
        lines, seen = [], []
        for _ in range(rnd.randint(1, 12)):
            terms = []
            for _ in range(rnd.randint(1, 3)):
                if seen and rnd.random() < 0.5:
                    terms.append(rnd.choice(seen))
                else:
                    terms.append('"' + "".join(rnd.choice("abXY12 zq") for _ in range(rnd.randint(1, 14))) + '"')
            name = rnd.choice(names)
            lines.append((name, terms))
            seen = [*dict.fromkeys([*seen, name])]
        text = "".join(f"{n} = {' + '.join(t)}\n" for n, t in lines)
        want = plain_run(lines)
        assert {(a, b) for a, _, b in secrets.lexed_spans(text)} == want, text
        hits += bool(want)
    assert hits > 100


@pytest.mark.parametrize(
    "text",
    ["x = '''" * 3000, 'x = """' * 3000, "a: `" * 5000, "k = (" * 5000, "a = b " * 5000, "x: /*" * 5000, "x=<<EOF\n" * 5000, "a:\n" * 5000, "n=\\\n" * 5000, "x = x + 'ab'\n" * 5000, "a=b=c=" * 5000],
)
def test_long_texts_take_linear_time(text):
    def took(t):
        began = time.perf_counter()
        secrets.spans_of(t + "password = x")
        return time.perf_counter() - began

    assert took(text * 4) < 8 * took(text) + 0.5


LITERAL = "Zx9!kQ2#vT7pLm4w"


@pytest.mark.parametrize("name", "dbpass userpwd authtoken accesskey secretkey clientsecret privatekey mypassword apitoken SECRETKEY pgpassword sshkey wifipassword".split())
def test_glued_names(name):
    assert LITERAL not in secrets.redact(f'{name} = "{LITERAL}"')


@pytest.mark.parametrize("name", "monkey turkey compass bypass author keyboard tokenizer secretary passenger accessory donkey hockey".split())
def test_words_that_look_glued(name):
    assert secrets.lexed_spans(f'{name} = "{LITERAL}"') == []


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        (f"secrets:\n  - {LITERAL}\n  - '{LITERAL[::-1]}'\nother: 1", [LITERAL, LITERAL[::-1]]),
        (f"tokens:\n- {LITERAL}\n- name: x", [LITERAL]),
        (f'String[] secrets = {{"{LITERAL}", "{LITERAL[::-1]}"}};', [LITERAL, LITERAL[::-1]]),
        (f'String apiToken = new String("{LITERAL}");', [LITERAL]),
        (f'user, password = "bob", "{LITERAL}"', [LITERAL]),
        (f'token, n, secret = "{LITERAL}", 3, "{LITERAL[::-1]}"', [LITERAL, LITERAL[::-1]]),
        (f'auth_token = "{LITERAL}" if production else "{LITERAL[::-1]}"', [LITERAL, LITERAL[::-1]]),
        (f'const authToken = prod ? "{LITERAL}" : "{LITERAL[::-1]}";', [LITERAL, LITERAL[::-1]]),
        (f'auth_token = os.environ.get("NAME") or "{LITERAL}"', [LITERAL]),
        (f'#define API_SECRET "{LITERAL}"\nint x = 1;', [LITERAL]),
        (f"- name: auth_token\n  description: {'what it is for ' * 60}\n  value: {LITERAL}", [LITERAL]),
        ('pwd = "qwerty99"', ["qwerty99"]), ('passphrase = "hunter2"', ["hunter2"]), ("db_password = 'P@ss1'", ["P@ss1"]),
    ],
)
def test_further_forms(text, literals):
    left = secrets.redact(text)
    assert not [x for x in literals if x in left], left


@pytest.mark.parametrize("n", [100, 10_000])
def test_operands_without_end(n):
    rnd = random.Random(n)
    parts = ["".join(rnd.choice("abcXYZ0189#!") for _ in range(8)) for _ in range(n)]
    joined = "auth_key = " + " + ".join(f'"{p}"' for p in parts)
    chain = "".join(f'k{i} = k{i - 1} + "{p}"\n' if i else f'k0 = "{p}"\n' for i, p in enumerate(parts)) + f"auth_key = k{n - 1}\n"
    listed = "secrets = [" + ", ".join('"' + "".join(rnd.sample(string.ascii_letters + string.digits, 20)) + '"' for _ in parts) + "]"
    for text in (joined, chain, listed):
        began = time.perf_counter()
        assert len(secrets.lexed_spans(text)) == n
        assert time.perf_counter() - began < 20


def test_recall_under_other_names_and_forms():
    """Names and forms that the lexer's tables don't list; prose and code around them adds no span."""
    rnd = random.Random(31)
    names = "prodDbPassword STRIPE_SECRET_KEY slackBotToken jwtSecret ENCRYPTION_KEY redisPass smtp_passwd myApiKey deployToken kafkaCredential vaultToken_v2 serviceAccountSecret".split()
    forms = ['let {n} = "{v}"', "{n}='{v}'", 'final String {n} = "{v}";', "self.{n} = '{v}'", 'os.environ["{n}"] = "{v}"', "  {n}: '{v}',", 'var {n} string = "{v}"', 'config.set("{n}", "{v}") \n{n} := "{v}"',
             "ENV {n}={v}", "set {n}={v}", "${n} = '{v}';", '<add key="x" {n}="{v}" />', 'private static final String {n} = "{v}";', "{n} => '{v}',"]
    prose = "The key idea of this pass is simple: access the token list, then sort. Note = see below.\nfor key in keys: print(key)\n"
    found = total = wrong = 0
    for _ in range(800):
        value = "".join(rnd.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rnd.randint(12, 40)))
        text = prose + rnd.choice(forms).format(n=rnd.choice(names), v=value) + "\n" + prose
        spans = secrets.spans_of(text)[1]
        total += 1
        left = secrets.redact(text)
        found += left.count(value) == (1 if "config.set" in text else 0) or value not in left
        wrong += sum(text[a:b] not in text[len(prose) : len(text) - len(prose)] for a, _, b in spans)
    assert found >= 0.9 * total and wrong == 0, (found, total, wrong)


def test_scan_of_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, f'auth_token = "{LITERAL}"', "x", 1), (None, f'auth_token = "{LITERAL}"', "x", 1), (3, None, "x", 1)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")).collect()
    assert sorted(((str(r.doc_id), r.n_assign, r.spans) for r in got)) == [("3", 0, ""), ("None", 0, "literal:14:30"), ("None", 0, "literal:14:30")]


def test_scan_of_an_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert secrets.redacted(spark.createDataFrame([], "doc_id long, text string")).count() == 0
