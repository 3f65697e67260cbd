"""The smallest tables, and texts that operators must survive."""

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\t ", "a", "Hello wörld's 12", "x<|endoftext|>y <|startoftext|> z", "ΑΣ ΑΣ. İ ﬁ ß", "é é 👍🏽 日本語　テスト",
    "same words here again", "same words here again", "Same WORDS here again", "a " * 3000, "q" * 20000, "12 " * 400, "\n" * 3000 + "end",
    "mail me at some.one+tag@mail.example.org, or a@b or @x.y or c@@d.ef", "on 10.0.0.256 and 192.168.1.1 and 1.2.3.4.5.6.7.8 and 0001.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111110000000",
    "call +44 (0)20 7946 0958. or +1-2 or +123456789012345678", "iban DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00",
    "ssn 123-45-6789 but part 123-45-6789", "%%% ### !!!", "NUL\x00byte \x1c\x1d \x85   sep"]
