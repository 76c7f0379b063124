"""The lexer of the secret scan."""

import random

from lattis.llm import secrets

V = "aB3dE5gH7jK9lM1n"
LEXED = {  # text: the literals that are found
    f'password = """{V}"""': [f'"""{V}"""'], f'{{"auth_token": get("x") or "{V}"}}': [f'"{V}"'], f"cfg:\n  private_key: |\n    MII{V}\n    x{V}\n  other: 1": [f"MII{V}\n    x{V}"],
    f"<privateKey>{V}</privateKey>": [V], f'a = "aB3dE5gH"\ntoken = f"{{a}}7jK9lM1n"': ['f"{a}7jK9lM1n"'], 'api_key = "aB3dE5gH" \\\n  "7jK9lM1n"': ['"aB3dE5gH" \\\n  "7jK9lM1n"'],
    f"export SECRET_KEY {V}": [V], f"setenv DB_PASSWORD {V}": [V], f'# password = "{V}"': [f'"{V}"'], f'{"n" * 200}_private_key = "{V}"': [f'"{V}"'], f'user, password = "bob", "{V}"': [f'"{V}"'],
    f'password: str = "{V}"': [f'"{V}"'], f'x = dict(password="{V}", user="bob")': [f'"{V}"'], f'<add key="db_password" value="{V}"/>': [f'"{V}"'], f"run --auth-token {V} now": [V],
    f'secret = os.environ.get("SECRET", "{V}")': [f'"{V}"'], "auth_token=abc+def/gh1JKL==": ["abc+def/gh1JKL=="], 'base = "aB3dE5"\nauth_token = base + "gH7jK9lM1n"': ['base + "gH7jK9lM1n"'],
    '"token": "\\x61B3dE5gH7jK9lM1n"': ['"\\x61B3dE5gH7jK9lM1n"'], f'secrets = {{\n  "password":\n   "{V}"\n}}': [f'"{V}"'], f"db.auth_token: {V}": [V], "let token = `abc-${x}-defgh1`;": ["`abc-${x}-defgh1`"],
    f'# base = "{V}"\nauth_token: base\n': [], "https://example.com/a?b=c&token=": [], "don't say: it's fine": [], "def f(password: str): pass": [], "password = get_password()": [], 'secret = load("db/secret")': [], "(((": [], "=": [], "a = (": [],
    f'title = "{V}"': [], 'key_file: "/etc/ssl/private/key.pem"': [], "x: '''": [], "token =\n": [], "a, = b = , =": [], f'note: {{password: "{V}"': [f'"{V}"'],
}


def test_literals():
    for text, want in LEXED.items():
        assert [text[s:e] for s, k, e in secrets.scan(text) if k == "lexed"] == want, text


def test_any_tokens_end():
    rng = random.Random(9)
    made = ["token", "=", ":", " ", "'", '"', '"""', "(", ")", "{", "}", "[", "]", ",", "\n", "\\", "`", "+", "|", "or", "x9", "get(", "#", "//", "<", ">", "</", "--a", "export ", "  ", "{a}", "f'"]
    for _ in range(3000):
        t = "".join(rng.choice(made) for _ in range(40))
        assert all(0 <= s < e <= len(t) for s, _, e in secrets.scan(t))


def test_long_text():
    long = "word " * 400_000 + f'\nprivate_key = "{V}"\n' + "x = (" * 20_000 + "'" * 30_000 + "a: " * 30_000
    assert [long[s:e] for s, k, e in secrets.scan(long) if k == "lexed"] == [f'"{V}"']
