"""Lines written by hand: what the fixed rules miss, and what looks like it and is none.

Of each line: the text, and the kind and words of the span to be added, if any.
"""

FOUND = [
    ("Please write to anna.meier [at] posteo [dot] de before Friday", "email", "anna.meier [at] posteo [dot] de"),
    ("contact: j_doe(at)mail.example.com", "email", "j_doe(at)mail.example.com"),
    ("You can reach me under paul at brightside dot org", "email", "paul at brightside dot org"),
    ("mail me: lucy @ wonder.net, any time", "email", "lucy @ wonder.net"),
    ("E-mail: sales (at) green-river (dot) com", "email", "sales (at) green-river (dot) com"),
    ("Fragen an info[at]verein-nord.de richten", "email", "info[at]verein-nord.de"),
    ("courriel: marc.petit (at) laposte.net", "email", "marc.petit (at) laposte.net"),
    ("correo: maria[at]empresa[dot]es", "email", "maria[at]empresa[dot]es"),
    ("She signs as tom99 at quickmail dot co", "email", "tom99 at quickmail dot co"),
    ("support [at] example [dot] org answers within a day", "email", "support [at] example [dot] org"),
    ("email bob.smith @ example.com for the keys", "email", "bob.smith @ example.com"),
    ("write to editor(at)daily-press(dot)net", "email", "editor(at)daily-press(dot)net"),
    ("The address is k.lee [at] university.edu as before", "email", "k.lee [at] university.edu"),
    ("login from 10[.]24[.]3[.]77 failed twice", "ip", "10[.]24[.]3[.]77"),
    ("the host 192[.]0[.]2[.]14 was blocked", "ip", "192[.]0[.]2[.]14"),
    ("server 172 . 16 . 4 . 9 answered", "ip", "172 . 16 . 4 . 9"),
    ("client 203(.)0(.)113(.)5 asked again", "ip", "203(.)0(.)113(.)5"),
    ("ip 198[dot]51[dot]100[dot]23 is listed", "ip", "198[dot]51[dot]100[dot]23"),
    ("host 2001:db8:85a3:0:0:8a2e:370:7334 came up", "ip", "2001:db8:85a3:0:0:8a2e:370:7334"),
    ("client fe80:1a2b:3c4d:5e6f:7a8b:9c0d:1e2f:3a4b left", "ip", "fe80:1a2b:3c4d:5e6f:7a8b:9c0d:1e2f:3a4b"),
    ("server 2001:db8::8a2e:370 does not answer", "ip", "2001:db8::8a2e:370"),
    ("ip fe80::1ff:fe23:4567 on the link", "ip", "fe80::1ff:fe23:4567"),
    ("login from 2001:470:1f0b::12 at night", "ip", "2001:470:1f0b::12"),
    ("Seen from 185[.]220[.]101[.]4 and others", "ip", "185[.]220[.]101[.]4"),
    ("card 4111/1111/1111/1111 was charged", "card", "4111/1111/1111/1111"),
    ("visa 4012.8888.8888.1881 is stored", "card", "4012.8888.8888.1881"),
    ("payment by 5555 . 5555 . 5555 . 4444 yesterday", "card", "5555 . 5555 . 5555 . 4444"),
    ("credit card 5105.1051.0510.5100 expired", "card", "5105.1051.0510.5100"),
    ("card no. 3566/0020/2036/0505 please", "card", "3566/0020/2036/0505"),
    ("his visa 4222.2222.2222.2220 is lost", "card", "4222.2222.2222.2220"),
    ("paid with 6011/1111/1111/1117 in the shop", "card", "6011/1111/1111/1117"),
    ("call (212) 555-0199 after six", "phone", "(212) 555-0199"),
    ("phone: 415-555-2671", "phone", "415-555-2671"),
    ("tel. 020 7946 0018, ask for Jo", "phone", "020 7946 0018"),
    ("mobile 0049 30 1234567", "phone", "0049 30 1234567"),
    ("Telefon 0176 4455667", "phone", "0176 4455667"),
    ("fax 212.555.0143", "phone", "212.555.0143"),
    ("reach me on 612 34 56 78", "phone", "612 34 56 78"),
    ("call 06 12 34 56 78 tonight", "phone", "06 12 34 56 78"),
    ("tel. 1-800-555-0123 is free", "phone", "1-800-555-0123"),
    ("mobile 0044 20 79460018 works abroad", "phone", "0044 20 79460018"),
    ("My cell is 917 555 0131", "phone", "917 555 0131"),
    ("dial (030) 901-8200 for the office", "phone", "(030) 901-8200"),
    ("whatsapp 646-555-0170", "phone", "646-555-0170"),
    ("phone 0033 1 2345678", "phone", "0033 1 2345678"),
    ("call 555-0147 for a table", "phone", "555-0147"),
    ("in words +1 (826) 555-4081 190.137.223.4 88 stood there", "phone", "+1 (826) 555-4081"),
]

CLEAN = [
    "We met at noon. Then we left for the coast.",
    "She arrived at seven. He was late as ever.",
    "Look at this. It is a picture of a house.",
    "dinner at eight dot that was the plan",
    "twelve apples @ 3.50 each",
    "two tickets @ 12.00 and a drink",
    "laughing at him. nobody spoke",
    "good at chess and bad at cards",
    "meet me at www.example.com for more",
    "The price (at) the door is higher",
    "at last. at least. at best.",
    "point at which dot products vanish",
    "version 4.12.7.3 of the tool",
    "the section 3.2.1.4 explains it",
    "ran 12:30:45:11 on the clock",
    "scores 10 . 900 . 7 . 1 were odd",
    "in std::vector we trust",
    "the class add::dead is abstract",
    "ratio 1:2:3:4 of the mix",
    "Genesis 1:1 and Exodus 2:3",
    "chapter 10.1.1 and 999.1.2.3 of the law",
    "lap times 01:02:03:04:05",
    "serial 4983211234567012",
    "order 5500 1234 9876 0001 was sent",
    "the number 1234567890123456 has no meaning",
    "item 9999 8888 7777 6666",
    "token = 9c8b45435718dcc700c184a7",
    "4183418637171908 is what it printed",
    "invoice no. 2021 0045 0078 1123",
    "order 123 456 7890 shipped",
    "invoice no. 415-555-2671 is open",
    "ISBN 978-3-16-148410-0",
    "from 1998-2004 and 2005-2011",
    "on 2021-03-14 at 10",
    "population 8336817 in 2020",
    "part 212.555.0143 fits",
    "serial 020 7946 0018 on the back",
    "12/31/1999 was a Friday",
    "page 1234-1240 of the volume",
    "pi is 3.14159265358",
    "a total of 1 000 000 people",
    "ref. 612 34 56 78",
    "copyright 1999-2003 by them",
    "zip 90210-1234 in the hills",
    "0.00012345 grams",
    "the years 1914 1918 1939 1945",
    "date 14/03/2021 10/04/2021",
    "coordinates 52.520008 13.404954",
    "id 5556667777",
    "version 10.15.7 (19) build 4570",
]
