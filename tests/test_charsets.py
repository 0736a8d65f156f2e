"""Charsets of text that is not UTF-8."""

import pytest

from keelson.sources.tree import decode

TEXTS = {
    "Russian": ("# настройки сервера базы данных\nПароль для подключения хранится здесь, не показывайте его никому\n", ("cp1251", "koi8-r", "iso8859-5", "cp866")),
    "Ukrainian": ("# налаштування сервера\nпароль для підключення зберігається тут, не показуйте його нікому\n", ("cp1251",)),
    "Bulgarian": ("# настройки на сървъра\nпаролата за базата данни се пази тук и не трябва да се споделя\n", ("cp1251",)),
    "Polish": ("# ustawienia połączenia z bazą danych\nhasło użytkownika jest zapisane poniżej, proszę go nie udostępniać\n", ("cp1250",)),
    "Czech": ("# nastavení připojení k databázi\nheslo uživatele je uloženo níže, prosím nesdílejte je s nikým\n", ("cp1250",)),
    "Hungarian": ("# az adatbázis beállításai\na jelszó itt található, kérjük ne ossza meg senkivel, őrizze meg jól, különben baj lesz belőle\n", ("cp1250",)),
    "French": ("# paramètres de la base de données\nle mot de passe est stocké ci-dessous, à ne pas partager, élève où êtes\n", ("cp1252",)),
    "German": ("# Einstellungen für die Datenbank\nPasswort für den Nutzer steht hier, größte Vorsicht, Übergröße\n", ("cp1252",)),
    "Spanish": ("# configuración de la contraseña\nel año pasado señor niño mañana\n", ("cp1252",)),
    "Portuguese": ("# configurações do servidor\na senha não deve ser partilhada, são informações e opções de sessões\n", ("cp1252",)),
    "Danish": ("# indstillinger for brugere på serveren\nløsenordet må ikke deles, æblegrød, øl\n", ("cp1252",)),
    "Finnish": ("Älä jaa tätä salasanaa, käyttäjän pääsy\n", ("cp1252",)),
    "Estonian": ("# serveri seaded\nära jaga seda parooli, õige käsi, üks öö\n", ("cp1252",)),
    "Japanese": ("これは日本語の設定ファイルです。パスワード\n", ("shift_jis", "euc_jp")),
    "Chinese": ("这是一个配置文件，里面有密码\n", ("gb18030",)),
}


@pytest.mark.parametrize("language, charset", [(k, c) for k, (_, cs) in TEXTS.items() for c in cs])
@pytest.mark.parametrize("before", ["", "x" * 70_000 + "\n", "key = 'k'\n" * 20])
def test_the_whole_text_settles_the_charset(language, charset, before):
    text = before + TEXTS[language][0]
    assert decode(text.encode(charset)) == text


def test_few_accents_are_western():
    assert decode("é à ü".encode("cp1252")) == "é à ü" and decode(b"caf\xe9") == "café"
    assert decode(b"\x80") == "€"
