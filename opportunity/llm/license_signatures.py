"""Signatures of licence texts and notices, written one by one: label, keyword, pattern.

Patterns are for lower-cased text with runs of blanks folded to one space. They are sentences of
the public licence texts and the headers that their stewards ask for. Each is tried only where its
keyword occurs; ``license_rules`` gives those that name a licence a higher priority than those
that only its text has.
"""

#: Sentences that name their licence.
HEADERS = (
    ("gpl", "free software foundation", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl", "gnu general public", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("gpl", "gnu general public", r"see the gnu general public licen[cs]e for more details"),
    ("gpl", "gpl", r"\bgpl ?v?[23](?:\.0)?(?: or later| only|\+)"),
    ("gpl", "linking exception", r"gpl(?:v?[23])? with (?:the )?(?:classpath|linking) exception"),
    ("gpl", "classpath", r"as a special exception, the copyright holders of this library give you permission to link"),
    ("gpl", "gcc runtime", r"gcc runtime library exception"),
    ("lgpl", "lesser general public", r"under the terms of the gnu lesser general public licen[cs]e as published"),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("lgpl", "library general public", r"you should have received a copy of the gnu library general public licen[cs]e"),
    ("lgpl", "lesser general public", r"see the gnu lesser general public licen[cs]e for more details"),
    ("lgpl", "lgpl", r"\blgpl ?v?(?:2|2\.1|3)(?:\.0)?(?: or later| only|\+)"),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[cs]e as published"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("agpl", "affero", r"see the gnu affero general public licen[cs]e for more details"),
    ("agpl", "agpl", r"\bagpl ?v?3(?:\.0)?(?: or later| only|\+)"),
    ("gfdl", "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("apache", "apache", r"licensed under the apache license, version 2\.0 \(the \"license\"\)"),
    ("apache", "apache", r"licensed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements"),
    ("apache", "apache", r"the apache software license, version 1\.1"),
    ("apache", "apache group", r"this product includes software developed by the apache (?:group|software foundation)"),
    ("mit", "mit", r"this (?:software|project|code|work|module|package) is (?:licensed|released|distributed|available) under the (?:terms of the )?mit licen[cs]e"),
    ("mit", "mit", r"\bmit licensed\b"),
    ("mit", "mit", r"licensed under the mit \(or expat\)"),
    ("bsd", "bsd", r"use of this source code is governed by a bsd-style licen[cs]e"),
    ("bsd", "bsd", r"this (?:software|project|code|module) is (?:licensed|released|distributed) under the (?:terms of the )?(?:simplified |modified |new )?bsd licen[cs]e"),
    ("bsd", "berkeley", r"this product includes software developed by the university of california, berkeley"),
    ("bsd", "regents", r"copyright .{0,40}the regents of the university of california"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public licen[cs]e"),
    ("epl", "eclipse.org/legal", r"https?://(?:www\.)?eclipse\.org/legal/epl-v\d+"),
    ("cpl", "common public", r"made available under the terms of the common public licen[cs]e"),
    ("ibm-pl", "ibm public", r"ibm public licen[cs]e version 1\.0"),
    ("cddl", "common development", r"subject to the terms of the common development and distribution licen[cs]e"),
    ("artistic", "artistic", r"under the (?:same terms as perl itself|terms of the artistic licen[cs]e)"),
    ("artistic", "perl itself", r"redistribute it and/or modify it under the same terms as perl"),
    ("psf", "python software foundation", r"python software foundation licen[cs]e(?: version 2)?"),
    ("psf", "python software foundation", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[cs]e"),
    ("ruby", "ruby", r"redistribute it and/or modify it under (?:either )?the (?:same )?terms (?:of|as) ruby"),
    ("php", "php license", r"this source file is subject to version 3\.\d{1,2} of the php licen[cs]e"),
    ("zend", "zend", r"subject to version 2\.\d{1,2} of the zend licen[cs]e"),
    ("zpl", "zope", r"subject to the provisions of the zope public licen[cs]e"),
    ("boost", "boost", r"distributed under the boost software licen[cs]e, version 1\.0"),
    ("boost", "boost.org", r"https?://(?:www\.)?boost\.org/license_1_0\.txt"),
    ("isc", "isc", r"this (?:software|project|code) is (?:licensed|released|distributed) under the (?:terms of the )?isc licen[cs]e"),
    ("zlib", "zlib", r"(?:licensed|released|distributed) under the (?:terms of the )?zlib(?:/libpng)? licen[cs]e"),
    ("libpng", "libpng", r"this code is released under the libpng licen[cs]e"),
    ("libtiff", "sam leffler", r"the names of sam leffler and silicon graphics may not be used"),
    ("ijg", "independent jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright .{0,40}the freetype project"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", "curl", r"this software is licensed as described in the file copying, which you should have received as part of this distribution"),
    ("unicode", "unicode", r"unicode(?:, inc\.)? licen[cs]e agreement"),
    ("icu", "icu license", r"icu licen[cs]e - icu [\d.]+ and later"),
    ("w3c", "w3c", r"w3c(?:\(r\)|®)? software (?:and document )?(?:notice and )?licen[cs]e"),
    ("ncsa", "ncsa", r"university of illinois/ncsa open source licen[cs]e"),
    ("ncsa", "llvm", r"this file is distributed under the university of illinois open source licen[cs]e"),
    ("llvm-exception", "llvm exception", r"apache license v2\.0 with llvm exceptions"),
    ("afl", "academic free", r"licensed under the academic free licen[cs]e version [\d.]+"),
    ("osl", "open software", r"licensed under the open software licen[cs]e version [\d.]+"),
    ("eupl", "eupl", r"licensed under the eupl(?:, version [\d.]+| v\.?[\d.]+)?"),
    ("cecill", "cecill", r"governed by the cecill(?:-[bc])? licen[cs]e under french law"),
    ("mulan", "mulan", r"licensed under mulan p(?:sl|ermissive software licen[cs]e)"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e(?: \(ms-pl\))?"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e(?: \(ms-rl\))?"),
    ("apsl", "apple public", r"apple public source licen[cs]e(?: version [\d.]+)?"),
    ("npl", "netscape public", r"subject to the netscape public licen[cs]e"),
    ("spl", "sun public", r"subject to the sun public licen[cs]e"),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e"),
    ("qpl", "q public", r"the q public licen[cs]e version 1\.0"),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e(?: version)? 1\.[\d]"),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e version 1\.0"),
    ("vim", "vim license", r"\bvim licen[cs]e\b"),
    ("tcl", "tcl", r"this software is copyrighted by the regents of the university of california, sun microsystems"),
    ("beerware", "beer", r"\"the beer-?ware licen[cs]e\" \(revision 42\)"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("unlicense", "unlicense.org", r"https?://(?:www\.)?unlicense\.org"),
    ("cc0", "cc0", r"to the extent possible under law, .{1,120}? waived all copyright and related or neighboring rights"),
    ("cc0", "cc0", r"\bcc0 1\.0 universal\b"),
    ("cc-by", "creative commons", r"creative commons attribution [234]\.[05] (?:international|unported|generic)(?: licen[cs]e)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution-share ?alike [234]\.[05] (?:international|unported|generic)"),
    ("cc-by-nc", "creative commons", r"creative commons attribution-non ?commercial [234]\.[05] (?:international|unported|generic)"),
    ("cc-by-nd", "creative commons", r"creative commons attribution-no ?derivat(?:ive)?(?:s|ives)? [234]\.[05] (?:international|unported|generic)"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution-non ?commercial-share ?alike [234]\.[05] (?:international|unported|generic)"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution-non ?commercial-no ?derivat(?:ive)?(?:s|ives)? [234]\.[05] (?:international|unported|generic)"),
    ("ofl", "sil open font", r"this font software is licensed under the sil open font licen[cs]e"),
    ("ofl", "reserved font name", r"with reserved font name"),
    ("bitstream-vera", "bitstream", r"bitstream vera is a trademark of bitstream"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e version 1\.0"),
    ("odbl", "open database", r"made available under the open database licen[cs]e"),
    ("odc-by", "odc", r"open data commons attribution licen[cs]e"),
    ("pddl", "public domain dedication", r"public domain dedication (?:and|&) licen[cs]e"),
    ("cdla", "community data", r"community data licen[cs]e agreement"),
    ("ogl", "open government", r"open government licen[cs]e(?: v[\d.]+)?"),
    ("gutenberg", "project gutenberg", r"project gutenberg(?:-tm|™)? licen[cs]e"),
    ("sspl", "server side public", r"server side public licen[cs]e(?:,? (?:version|v) ?1)?"),
    ("busl", "business source", r"business source licen[cs]e(?: 1\.1)?"),
    ("elastic", "elastic license", r"elastic licen[cs]e(?: 2\.0)?"),
    ("commons-clause", "commons clause", r"\"commons clause\" licen[cs]e condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[cs]e"),
    ("openrail", "rail", r"\b(?:open|bigscience|bigcode)[ -]?(?:open)?rail(?:-[ms]){0,2}(?: licen[cs]e)\b"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e(?: version)? [\d.]+"),
    ("json", "good, not evil", r"the software shall be used for good, not evil"),
    ("upl", "universal permissive", r"the universal permissive licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("sleepycat", "sleepycat", r"\bsleepycat (?:software )?(?:public )?licen[cs]e"),
    ("intel", "intel", r"intel (?:simplified|open source) (?:software )?licen[cs]e"),
    ("bsl", "bsl", r"licensed under the bsl 1\.1"),
    ("latex", "latex project", r"latex project public licen[cs]e"),
    ("gust", "gust font", r"gust font (?:source )?licen[cs]e"),
    ("ecl", "educational community", r"educational community licen[cs]e, version [\d.]+"),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e 1\.0\.0"),
    ("anti-996", "996", r"anti[- ]996 licen[cs]e"),
)

#: Sentences of the texts themselves, which do not name their licence.
CLAUSES = (
    ("mit", "sublicense", r"to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided", r"the software is provided \"as is\", without warranty of any kind, express or implied"),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "copyright holders", r"this software is provided by the copyright holders and contributors \"as is\""),
    ("isc", "the author disclaims", r"the software is provided \"as is\" and the author disclaims all warranties"),
    ("isc", "fee is hereby granted", r"with or without fee is hereby granted"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this", r"the origin of this software must not be misrepresented"),
    ("apache", "compliance with the license", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "as is\" basis", r"distributed on an \"as is\" basis, without warranties or conditions of any kind"),
    ("apache", "grant of patent", r"grant of patent licen[cs]e\. subject to the terms and conditions"),
    ("gpl", "copyleft", r"the gnu general public licen[cs]e is a free, copyleft licen[cs]e"),
    ("gpl", "freedom to share", r"guarantee your freedom to share and change (?:free software|all versions of a program)"),
    ("gpl", "warranty of merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl", "network", r"interacting with it remotely through a computer network"),
    ("lgpl", "library", r"work that uses the library"),
    ("mpl", "larger work", r"you may create and distribute a larger work under terms of your choice"),
    ("epl", "commercial distributor", r"accept certain responsibilities with respect to end users, business partners and the like"),
    ("cc-by", "attribution", r"you must give appropriate credit, provide a link to the licen[cs]e"),
    ("cc-by-sa", "share", r"you must distribute your contributions under the same licen[cs]e as the original"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc0", "waive", r"hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("unlicense", "anyone is free", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "you just do", r"you just do what the fuck you want to"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("artistic", "standard version", r"you may (?:freely )?(?:make and give away|apply bug fixes|distribute) .{0,60}the standard version"),
    ("boost", "machine-executable", r"machine-executable object code generated by a source language processor"),
    ("public-domain", "public domain", r"\bthis (?:software|work|code|file|program) is in the public domain\b"),
    ("public-domain", "author disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", "united states government", r"work of the (?:united states|u\.s\.) government"),
    ("proprietary", "confidential", r"\bstrictly confidential\b"),
    ("proprietary", "trade secret", r"contains (?:trade secrets|proprietary and confidential information)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of (?:this|the) .{0,40}(?:file|software|material)s?.{0,40}prohibited"),
    ("proprietary", "evaluation", r"for evaluation purposes only"),
    ("proprietary", "end user license", r"end[- ]user licen[cs]e agreement"),
    ("proprietary", "non-commercial", r"for non-commercial (?:use|purposes) only"),
    ("proprietary", "reverse engineer", r"may not (?:decompile, )?reverse[- ]engineer"),
)
