import random
import string

import pytest

from tracewell.llm.secrets import find_credentials, redact, residual, spans, use_words

R = random.Random(7)
TOKEN = "".join(R.choices(string.ascii_letters + string.digits, k=36))
B64 = "".join(R.choices(string.ascii_letters + string.digits + "+/", k=70))
PW = "Harbor" + "-Meadow-" + "73"
SHOWN = [
    f'db_password = "{PW}"', f"API_KEY={TOKEN}", f"curl -H 'Authorization: Bearer {TOKEN}' https://x.test", f"postgres://app:{PW}@db.test/x", f"git clone https://u:ghp_{TOKEN}@h.test/r.git",
    f'"kennwort": "{PW}",', f"set(clave, {TOKEN})", f'<add key="mot_de_passe" value="{PW}" />', f"x.setProperty('authToken', '{TOKEN}');", f"ENV MYAPIKEY {TOKEN}", f"mysqldump -u root -p'{PW}' db",
    f"curl -u joe:{PW} https://x.test", f"sshpass -p {PW} ssh a@b.test", f"machine a.test login joe password {PW}", f"//r.test/:_authToken={TOKEN}", f"https://s.test/o?sig={TOKEN}%3D&se=2031", f"AccountKey={B64}==;Endpoint=x",
    f'token = "{TOKEN[:18]}" + "{TOKEN[18:]}"', f"v = ''.join(['{TOKEN[:18]}', '{TOKEN[18:]}'])  # signing_key", "-----BEGIN RSA PRIVATE KEY-----\\n" + B64, f"# old login for a.test: joe / {PW}", f"proxy = http://u:{TOKEN[:14]}@p.test:1",
]
CLEAN = [
    'password = "changeme"', 'token = "your-token"', "api_key: ${API_KEY}", 'secret = os.environ["SECRET"]', "pwd = getpass.getpass('x: ')", "passwd: ********", f"token = {TOKEN[:4]}...{TOKEN[-3:]}", "postgres://app:[REDACTED]@db.test/x",
    "password_min_length = 12", 'token_type = "bearer"', "secret_rotation_days: 30", 'key_file = "/run/secrets/db"', "secret_ref: arn:store:a:b", "if not x.check_password(value):", "def reset_password(user, x):", "secretKeyRef: {name: a, key: b}",
    'request_id = "60d66836-59e1-4169-a876-445f3325f746"', "commit " + "0a" * 20, "sha256: " + "ab" * 32, 'etag: "' + "0f" * 16 + '"', "-----BEGIN PUBLIC KEY-----\\n" + B64, "-----BEGIN CERTIFICATE-----\\n" + B64, "uses: o/r@" + "0b" * 20,
    f"ssh-ed25519 {B64} me", "", "label for=x Password y </label>", 'apikey = "xxxxxxxxxxxxxxxx"', 'token = "{{ secrets.x }}"', 'pw = "%(name)s"',
]


@pytest.mark.parametrize("line", SHOWN)
def test_shown(line):
    assert spans(line)
    out = redact(line)
    assert "[REDACTED]" in out and PW not in out and TOKEN not in out
    # nothing but the value went
    at = 0
    for a, b in spans(line):
        assert line[at:a] in out
        at = b
    assert out.endswith(line[at:])


@pytest.mark.parametrize("line", CLEAN)
def test_clean(line):
    assert not spans(line), spans(line)
    assert redact(line) == line


def test_bare_values_are_told_by_their_path():
    assert spans(TOKEN + ";", "conf/x/secrets/api_token") and spans(TOKEN, "run\\auth.token")
    assert not spans(TOKEN, "release/checksums.sha1") and not spans(TOKEN, None) and not spans(TOKEN, "lib/x.py")


def test_residual_explains_words():
    use_words({"harbor": 40, "meadow": 9, "the": 400})
    assert residual("harbor-meadow") == 0 and residual("Harbor") == 0 and residual("") == 0
    assert residual(TOKEN) > 15 and residual(TOKEN * 40) > 500


def test_operator_with_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, SHOWN[0], "a", 9), (1, SHOWN[0], "a", 9), (2, None, "a", 9), (3, "", None, 9), (None, SHOWN[0], "a", 9), (4, SHOWN[1], None, 9), (5, CLEAN[0], "a", 9)], "finding_id bigint, excerpt string, path string, redacted int")
    got = {r.finding_id: r.redacted for r in find_credentials(df).collect()}
    assert set(got) == {1, 4} and got[1] == 'db_password = "[REDACTED]"'
    assert find_credentials(df.limit(0)).count() == 0


def test_the_gate_in_spark_lets_every_case_pass(spark):
    df = spark.createDataFrame([(i, s, "a") for i, s in enumerate(SHOWN)], "finding_id bigint, excerpt string, path string")
    assert find_credentials(df).count() == len(SHOWN)


HEX = "".join(R.choices("0123456789abcdef", k=128))
HASHES = [
    f"token_sha256 = '{HEX[:64]}'", f"apikey_digest: {HEX[:40]}", f"passwordHash = '{HEX[:32]}'", f'"secret_checksum": "{HEX[:64]}",', f"private_key_fingerprint={':'.join([HEX[i : i + 2] for i in range(0, 32, 2)])}", f"hashedPassword = '{HEX}'", f"md5_of_token = {HEX[:32]}",
    f'password = "sha256:{HEX[:64]}"', f"token = '{HEX[:64]}'  # sha256 of the token", f"x-api-key-sha256: {HEX[:64]}", f'token_sha_256 = "{HEX[:32]}" + "{HEX[32:64]}"', "password = '$2b$12$" + TOKEN + TOKEN[:17] + "'", f"api_key_hash_hex => '{HEX[:40]}'",
]
KEYS = [
    f"token = '{HEX[:64]}'", f"apikey: {HEX[:40]}", f"hash_key_secret = '{HEX[:32]}'", f"hmac_secret = '{HEX[:64]}'", f"digest_token = {HEX[:40]}", f"password_hash = '{HEX[:32]}', secret = '{HEX[32:72]}'", f"secret = '{HEX[:64]}', checksum = '{HEX[64:]}'", f"token_sha256 = '{TOKEN}'",
    f"token = '{HEX[:64]}'  # rotate monthly", f"x-api-key: {HEX[:64]}",
]


@pytest.mark.parametrize("line", HASHES)
def test_hashes_of_credentials_are_none(line):
    assert not spans(line) and redact(line) == line


@pytest.mark.parametrize("line", KEYS)
def test_hex_under_a_keys_own_name_is_one(line):
    assert len(spans(line)) == 1


BLANKS = [
    "passphrase = 'kX9 harbor 73 Qz7 otter'", 'password: "Tr4v eller! 9xQ#"', "secret = 'kX9 harbor' + ' Qz7 otter'", '"passwort": "vB7k mM2x qP9z wT4r",', f"token = '{TOKEN[:18]} {TOKEN[18:]}'",
    'password = "$ecr3t!Kx92vQ"', "DB_PASSWORD=$ecr3t!Kx92vQ", "token: '$kX9-vQ72-mmZ3'",
]
NO_BLANKS = [
    'password = "Enter your password, at least 8 characters"', "token: 'Das Token ist abgelaufen, bitte 2 Minuten warten'", 'print("password:", cfg.k9xq7Z, "done")', "secret = 'a base64 encoded SHA256 of the key'", "passphrase = 'the quick brown fox'", '"password": "Le mot de passe doit être changé",',
    "password = '$DB_PASSWORD'", "password=$db_pass", "$password = $this->k9xq7Z;", 'token = "${TOKEN:-x9Kq2 zz}"', 'secret = "$(vault read -field=k9X q7Z)"', "password=$PASS&user=$USER", "pwd = $env:DB_PW", 'token = "$PREFIX-$SUFFIX"', "apikey: $config['k']", "secret = 'see RFC 7617 for {name} and https://x.test/k9Xq7Z'",
]


@pytest.mark.parametrize("line", BLANKS)
def test_values_with_blanks_and_dollars(line):
    assert spans(line)
    assert not any(x in redact(line) for x in ("Qz7", "9xQ", "vB7k", "Kx92", "vQ72", TOKEN[:18]))


@pytest.mark.parametrize("line", NO_BLANKS)
def test_running_text_and_references_are_none(line):
    assert not spans(line), spans(line)
