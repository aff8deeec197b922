import pytest

from tidemark.llm import licenses

MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = f"""{BSD_2}
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
"""
GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL_2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
GPL_2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007
"""
ISC = """Copyright (c) 2004-2010 by A Holder

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
BSD_HOLDER = f"""Copyright (c) 1998, Some University. All rights reserved.

{BSD_3}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
BSD_4 = f"""Copyright (c) 1990 A Holder.
All rights reserved.

{BSD_2}
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by A Holder.

4. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
LGPL_3 = """This file is free software: you can redistribute it and/or modify it under
the terms of the GNU Lesser General Public License as published by the Free
Software Foundation, version 3.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
EPL = """Copyright (c) 2019 Contributors.

This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
CC_BY_SA = """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0
International License.
"""
CC_0 = """The person who associated a work with this deed has dedicated the work to the
public domain by waiving all of his or her rights to the work worldwide under
copyright law, including all related and neighboring rights, to the extent
allowed by law.
"""
APACHE_TITLE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/
"""
TEXTS = [
    (MIT, "MIT"), (BSD_2, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (GPL_3, "GPL-3-or-later"), (GPL_2, "GPL-2-or-later"), (GPL_2_ONLY, "GPL-2"), (LGPL, "LGPL-2.1-or-later"), (MPL, "MPL-2.0"), (TITLE, "GPL-3"),
    (ISC, "ISC"), (BSD_HOLDER, "BSD-3-Clause"), (BSD_4, "BSD-4-Clause"), (AGPL, "AGPL-3-or-later"), (LGPL_3, "LGPL-3"), (UNLICENSE, "Unlicense"), (ZLIB, "Zlib"), (BOOST, "BSL-1.0"), (EPL, "EPL-2.0"), (CC_BY_SA, "CC-BY-SA-4.0"), (CC_0, "CC0"), (APACHE_TITLE, "Apache-2.0"),
]


@pytest.mark.parametrize("text,licence", TEXTS)
def test_published_texts(text, licence):
    scanner = licenses.Scanner(licenses.KNOWN, licenses.ALL_RULES)
    read = lambda x: scanner.licences(scanner.identify(x))
    commented = "\n".join(f" * {line}".rstrip() for line in text.split("\n"))
    for form in (text, commented, text.replace("\n", "\r\n"), f"prose without an end\n{text}more prose"):
        assert read(form) == [licence], form


def test_all_of_them_in_a_table(spark):
    docs = spark.createDataFrame(list(enumerate(x for x, _ in TEXTS)), "doc_id long, text string")
    assert {r["doc_id"]: r["licences"] for r in licenses.scan(docs).collect()} == {k: [x] for k, (_, x) in enumerate(TEXTS)}


def test_a_wrapped_sentence_takes_no_more_than_it_needs():
    scanner = licenses.Scanner(licenses.KNOWN, licenses.ALL_RULES)
    text = "Licensed under the GNU General Public License version 3\nor later\nLicensed under the GNU General\nPublic License version 2\nReleased under the MIT License"
    assert scanner.licences(scanner.identify(text)) == ["GPL-3-or-later", "GPL-2", "MIT"]


@pytest.mark.parametrize("text,licence", [x for x in TEXTS if x[0] not in (TITLE, APACHE_TITLE, APACHE, MPL, EPL, UNLICENSE, CC_BY_SA)])
def test_published_texts_on_one_line(text, licence):
    """Long sentences are found where no line or full stop sets them off."""
    scanner = licenses.Scanner(licenses.KNOWN, licenses.ALL_RULES)
    line = " ".join(text.split())
    for form in (line, f"Some Title, (c) 2020 by A. Holder, {line}", f"/* {line} */", line.upper()):
        assert [x for x in scanner.licences(scanner.identify(form)) if x != "Proprietary"] == [licence], form


@pytest.mark.parametrize(
    "name,licence",
    [("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-only", "GPL-2.0"), ("GPL-3.0-or-later", "GPL-3.0-or-later"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("CC0-1.0", "CC0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("MIT OR Apache-2.0", "MIT OR Apache-2.0")],
)
def test_identifier_lines(name, licence):
    scanner = licenses.Scanner(licenses.KNOWN, licenses.ALL_RULES)
    for form in (f"SPDX-License-Identifier: {name}", f"// SPDX-License-Identifier: {name}\nint main() {{}}", f"#!/bin/sh\n# SPDX-License-Identifier: {name}\n", f"/* SPDX-License-Identifier: {name} */"):
        assert scanner.licences(scanner.identify(form)) == [licence], form


def test_near_misses():
    scanner = licenses.Scanner(licenses.KNOWN, licenses.ALL_RULES)
    for text in (
        MIT.replace("free of charge, ", ""), GPL_3.replace("GNU General", "Example General"), ISC.replace("with or without fee", "without fee"), BSD_2.split("1.")[0], "Not licensed under the MIT license at all.",
        "SPDX-License-Identifier: Custom-1.0", "permission is hereby granted", AGPL.replace("either version 3 of the License, or", ""), "We like the Apache License, Version 2.0", "", "This program is free software. You can sell it.",
    ):
        assert not scanner.licences(scanner.identify(text)), text
