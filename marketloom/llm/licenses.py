"""License scans by ordered signature rules, in DataFrame operations only.

A text's words (A-Z lower-cased, runs of digits, a-z and non-ASCII) are joined
by single spaces, and rules are regular expressions over that line.  Rules are
gated by keywords, single words one of which stands in every match of a rule: a
text's words are intersected with all keywords once, the line is built only
where one occurs, and a rule runs only where its own do.  Detections are word intervals
with a priority; one that lies inside an earlier-starting or longer interval
of at least its own priority is suppressed.  Everything happens in the row, so
no text is shuffled and no key can be hot.

A null text counts as empty: no words, no detections, score 0.  Ties (equal
interval and priority) keep the rule that stands first.  Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and labels (fixed values of the contract).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, keywords, regular expression of the licence's name over normalised words).
NAMES = (
    ("mit", "mit expat x11", r"(?:the )?(?:mit|expat|x11) licen[cs]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("apache-2.0", "apache", r"(?:the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache", "apache", r"(?:the )?apache(?: software)? licen[cs]e"),
    ("gpl-1.0", "general", r"(?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: (?:version|v))? v?1(?: 0)?"),
    ("gpl-2.0", "general", r"(?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: (?:version|v))? v?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: (?:version|v))? v?3(?: 0)?"),
    ("gpl", "general", r"(?:the )?(?:gnu )?general public licen[cs]e"),
    ("lgpl-2.0", "general", r"(?:the )?(?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version 2)?(?: 0)?"),
    ("lgpl-2.1", "general", r"(?:the )?(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: (?:version|v))? v?2 1"),
    ("lgpl-3.0", "general", r"(?:the )?(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: (?:version|v))? v?3(?: 0)?"),
    ("lgpl", "general", r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl-3.0", "affero", r"(?:the )?(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: (?:version|v))? v?3(?: 0)?"),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public licen[cs]e"),
    ("gfdl", "documentation", r"(?:the )?(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:2|two|simplified|freebsd)(?: clause)? bsd(?: style)? licen[cs]e|(?:the )?bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:3|three|new|revised|modified)(?: clause)? bsd(?: style)? licen[cs]e|(?:the )?bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:4|four|original|old)(?: clause)? bsd(?: style)? licen[cs]e"),
    ("0bsd", "0bsd", r"(?:the )?0bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[cs]e(?: mpl)?(?: (?:version|v))? v?1 1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public licen[cs]e(?: mpl)?(?: (?:version|v))? v?2(?: 0)?"),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public licen[cs]e(?: epl)?(?: (?:version|v))? v?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public licen[cs]e(?: epl)?(?: (?:version|v))? v?2(?: 0)?"),
    ("edl-1.0", "eclipse", r"(?:the )?eclipse distribution licen[cs]e"),
    ("cddl", "cddl", r"(?:the )?common development and distribution licen[cs]e cddl"),
    ("cddl-1.0", "development", r"(?:the )?common development and distribution licen[cs]e"),
    ("cpl-1.0", "common", r"(?:the )?common public licen[cs]e"),
    ("eupl", "european", r"(?:the )?european union public licen[cs]e"),
    ("artistic-1.0", "artistic", r"(?:the )?artistic licen[cs]e(?: version)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", r"(?:the )?artistic licen[cs]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", r"(?:the )?boost software licen[cs]e(?: version 1 0)?"),
    ("psf", "python", r"(?:the )?python software foundation licen[cs]e"),
    ("php", "php", r"(?:the )?php licen[cs]e"),
    ("ofl", "font", r"(?:the )?(?:sil )?open font licen[cs]e"),
    ("odbl", "database", r"(?:the )?open (?:data commons open )?database licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "want", r"(?:the )?do what the fuck you want to public licen[cs]e"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "creative", r"(?:the |a )?creative commons attribution(?: [234] 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-sa", "creative", r"(?:the |a )?creative commons attribution share ?alike(?: [234] 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nc", "creative", r"(?:the |a )?creative commons attribution non ?commercial(?: [234] 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc-by-nd", "creative", r"(?:the |a )?creative commons attribution no ?derivatives(?: [234] 0)?(?: international| unported| generic)? licen[cs]e"),
    ("cc", "creative", r"(?:the |a )?creative commons licen[cs]e"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[cs]e"),
    ("openssl", "openssl", r"(?:the )?openssl licen[cs]e"),
    ("vim", "vim", r"(?:the )?vim licen[cs]e"),
)

#: (kind, priority, confidence in percent, what stands before and after a name).
FORMS = (
    ("grant", 40, 100, r"(?:licensed|released|distributed|available|provided|published|made available|covered)(?: to you)? (?:only )?under (?:the terms (?:and conditions )?of )?(?:{name})", ""),
    ("terms", 35, 95, r"(?:subject to|governed by|according to|in accordance with|under)(?: the)? (?:terms|conditions|provisions) of (?:{name})", ""),
    ("redistribution", 35, 95, r"(?:redistribute|redistribution|modify|copy|use)(?: \S+){{0,6}} under (?:the terms of )?(?:{name})", ""),
    ("notice", 30, 90, r"(?:see|read|refer to|consult)(?: the)?(?: file)? (?:{name})(?: for)?(?: more)?(?: details)?", ""),
    ("copy", 30, 90, r"(?:a copy of|obtain a copy of|received a copy of) (?:{name})", ""),
    ("name", 20, 80, r"(?:{name})", ""),
)

#: Sentences of licence texts and file headers: (label, priority, confidence, keywords, expression).
TEXTS = (
    ("mit", 50, 100, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 50, 95, "substantial", r"shall be included in all copies or substantial portions of the software"),
    ("mit", 50, 95, "sublicense", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", 45, 90, "noninfringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 45, 90, "liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", 50, 95, "advertising", r"except as contained in this notice the names? of(?: \S+){1,10} shall not be used in advertising"),
    ("boost", 55, 100, "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", 50, 95, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 50, 95, "warranties", r"the software is provided as is and the authors? disclaims? all warranties with regard to this software"),
    ("isc", 45, 90, "consequential", r"in no event shall the authors? be liable for any special direct indirect or consequential damages"),
    ("hpnd", 55, 95, "documentation", r"permission to use copy modify (?:distribute )?and (?:distribute|sell) this software and its documentation for any purpose"),
    ("bsd", 50, 100, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 50, 95, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 50, 95, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 50, 95, "endorse", r"neither the names? of(?: \S+){1,12} may be used to endorse or promote products"),
    ("bsd-4-clause", 50, 95, "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-4-clause", 50, 95, "acknowledgment", r"all advertising materials mentioning features or use of this software must display the following acknowledgment"),
    ("bsd", 45, 90, "express", r"this software is provided by the(?: \S+){1,8} as is and any express or implied warranties"),
    ("bsd", 45, 90, "exemplary", r"be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", 40, 85, "regents", r"the regents of the university of california"),
    ("bsd", 40, 90, "governed", r"use of this source code is governed by a bsd style license"),
    ("bsd-2-clause-patent", 50, 95, "receiving", r"each copyright holder and contributor hereby grants to those receiving rights under this license"),
    ("gpl", 45, 95, "foundation", r"general public license as published by the free software foundation"),
    ("gpl", 45, 90, "warranty", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 45, 95, "redistribute", r"this (?:program|file|software|package) is free software you can redistribute it and or modify"),
    ("gpl-1.0-or-later", 45, 90, "option", r"either version 1 (?:of the license )?or at your option any later version"),
    ("gpl-2.0-or-later", 45, 90, "option", r"either version 2 (?:of the license )?or at your option any later version"),
    ("gpl-3.0-or-later", 45, 90, "option", r"either version 3 (?:of the license )?or at your option any later version"),
    ("gpl", 45, 95, "gnu", r"you should have received a copy of the gnu general public license"),
    ("gpl", 45, 95, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-2.0", 50, 95, "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", 50, 90, "verbatim", r"you may copy and distribute verbatim copies of the program s source code"),
    ("gpl-2.0", 50, 90, "derived", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-3.0", 50, 95, "copyleft", r"the gnu general public license is a free copyleft license for software"),
    ("gpl-3.0", 50, 90, "convey", r"you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", 45, 90, "propagate", r"you may make run and propagate covered works that you do not convey"),
    ("gpl-1.0", 25, 80, "gplv1", r"gplv1"),
    ("gpl-2.0", 25, 80, "gplv2", r"gplv2(?: 0)?"),
    ("gpl-3.0", 25, 80, "gplv3", r"gplv3(?: 0)?"),
    ("gpl", 20, 70, "gpl", r"gnu gpl"),
    ("gpl-2.0", 25, 75, "gpl", r"gpl (?:version |v )?2(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", 25, 75, "gpl", r"gpl (?:version |v )?3(?: 0)?(?: or later| only)?"),
    ("gpl-classpath-exception", 50, 95, "classpath", r"(?:gnu )?classpath exception"),
    ("gpl-classpath-exception", 50, 95, "statically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-font-exception", 50, 90, "embed", r"if you create a document which uses this font and embed this font"),
    ("gpl-gcc-exception", 50, 95, "gcc", r"gcc runtime library exception"),
    ("gpl-bison-exception", 50, 95, "bison", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", 50, 90, "autoconf", r"configuration script generated by autoconf"),
    ("lgpl", 45, 95, "library", r"this library is free software you can redistribute it and or modify"),
    ("lgpl", 45, 90, "library", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-2.1", 50, 90, "derivative", r"a program that contains no derivative of any portion of the library"),
    ("lgpl-2.0", 25, 80, "lgplv2", r"lgplv2(?: 0)?"),
    ("lgpl-2.1", 25, 80, "lgplv2", r"lgplv2 1"),
    ("lgpl-3.0", 25, 80, "lgplv3", r"lgplv3(?: 0)?"),
    ("lgpl", 20, 70, "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e)?"),
    ("agpl-3.0", 50, 95, "remotely", r"must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl-3.0", 25, 80, "agplv3", r"agplv3(?: 0)?"),
    ("agpl", 20, 70, "agpl", r"(?:gnu )?agpl(?: licen[cs]e)?"),
    ("sspl-1.0", 45, 95, "server", r"server side public licen[cs]e(?: version 1| v1)?"),
    ("sspl-1.0", 50, 95, "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("gfdl", 50, 95, "invariant", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("gfdl", 50, 95, "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("apache-2.0", 50, 100, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 45, 90, "apache", r"www apache org licenses license 2 0"),
    ("apache-2.0", 50, 95, "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", 50, 95, "governing", r"see the license for the specific language governing permissions and limitations"),
    ("apache-2.0", 50, 95, "irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache", 45, 90, "apache", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache-2.0", 20, 70, "apache", r"apache 2 0"),
    ("apache-2.0", 20, 70, "asl", r"asl 2 0"),
    ("mpl-2.0", 50, 100, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", 50, 95, "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 50, 95, "contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 50, 90, "secondary", r"this source code form is incompatible with secondary licenses"),
    ("mpl", 20, 70, "mpl", r"mpl (?:1 1|2 0)"),
    ("netscape", 45, 90, "netscape", r"netscape public licen[cs]e"),
    ("epl", 50, 95, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("epl", 20, 70, "epl", r"epl (?:1 0|2 0)"),
    ("cddl-1.0", 50, 95, "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", 50, 90, "cddl", r"include this cddl header in a conspicuous location"),
    ("ibm-pl", 45, 90, "ibm", r"ibm public licen[cs]e"),
    ("eupl", 45, 95, "eupl", r"licen[cs]ed under the eupl"),
    ("eupl", 20, 70, "eupl", r"eupl(?: v)?(?: 1 [012])?"),
    ("cecill", 45, 90, "cecill", r"cecill(?: [bc])?(?: licen[cs]e)?"),
    ("artistic", 50, 90, "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", 45, 95, "perl", r"under the same terms as perl itself"),
    ("ruby", 45, 95, "ruby", r"under the same terms as ruby(?: itself)?"),
    ("ruby", 20, 80, "ruby", r"ruby licen[cs]e"),
    ("zlib", 50, 95, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 50, 95, "plainly", r"altered source versions must be plainly marked as such"),
    ("zlib", 50, 95, "altered", r"this notice may not be removed or altered from any source distribution"),
    ("zlib", 45, 90, "held", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", 50, 95, "png", r"the png reference library is supplied as is"),
    ("psf", 50, 95, "psf", r"psf is making python available to licensee on an as is basis"),
    ("psf", 45, 90, "beopen", r"beopen(?: com)?(?: python open source)? licen[cs]e agreement"),
    ("psf", 45, 90, "cnri", r"cnri (?:open source )?licen[cs]e(?: agreement)?"),
    ("php", 50, 95, "php", r"this product includes php software freely available from"),
    ("ofl", 50, 95, "font", r"this font software is licensed under the sil open font license"),
    ("ofl", 45, 85, "font", r"with reserved font names?"),
    ("odc-by", 45, 95, "commons", r"open data commons attribution licen[cs]e"),
    ("pddl", 45, 95, "dedication", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("unlicense", 50, 100, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 50, 95, "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 55, 95, "changing", r"verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0", 50, 95, "waived", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0", 45, 95, "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 45, 95, "creativecommons", r"creativecommons org licen[cs]es by [1234] [05]"),
    ("cc-by-sa", 45, 95, "creativecommons", r"creativecommons org licen[cs]es by sa [1234] [05]"),
    ("cc-by-nc", 45, 95, "creativecommons", r"creativecommons org licen[cs]es by nc [1234] [05]"),
    ("cc-by-nd", 45, 95, "creativecommons", r"creativecommons org licen[cs]es by nd [1234] [05]"),
    ("cc-by-nc-sa", 45, 95, "creativecommons", r"creativecommons org licen[cs]es by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 45, 95, "creativecommons", r"creativecommons org licen[cs]es by nc nd [1234] [05]"),
    ("cc-by", 25, 80, "cc", r"cc by(?: [1234] [05])?"),
    ("cc-by-sa", 25, 85, "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nc", 25, 85, "cc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", 25, 85, "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", 30, 85, "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", 30, 85, "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by", 45, 90, "credit", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", 45, 90, "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e"),
    ("cc-by-nc", 45, 90, "commercial", r"you may not use the material for commercial purposes"),
    ("ms-pl", 45, 85, "bear", r"the software is licensed as is you bear the risk of using it"),
    ("ms-rl", 45, 95, "reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("rpl", 45, 95, "reciprocal", r"reciprocal public licen[cs]e"),
    ("openssl", 50, 95, "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", 50, 95, "cryptographic", r"this product includes cryptographic software written by"),
    ("beerware", 50, 95, "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("beerware", 30, 85, "beerware", r"(?:the )?beerware licen[cs]e"),
    ("json", 50, 95, "evil", r"the software shall be used for good not evil"),
    ("unicode", 45, 90, "unicode", r"unicode(?: inc)? licen[cs]e(?: agreement)?"),
    ("icu", 45, 90, "icu", r"icu licen[cs]e"),
    ("ncsa", 45, 95, "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e"),
    ("afl", 45, 95, "academic", r"academic free licen[cs]e(?: version [123](?: [01])?)?"),
    ("osl", 40, 90, "open", r"open software licen[cs]e(?: version [123](?: [01])?)?"),
    ("ecl-2.0", 45, 95, "educational", r"educational community licen[cs]e(?: version [12] 0)?"),
    ("lppl", 45, 95, "latex", r"latex project public licen[cs]e"),
    ("sleepycat", 45, 95, "sleepycat", r"sleepycat licen[cs]e"),
    ("sleepycat", 50, 90, "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("w3c", 45, 95, "w3c", r"w3c(?: r)? software(?: and document)? notice and licen[cs]e"),
    ("zpl", 45, 95, "zope", r"zope public licen[cs]e(?: version)?(?: [12] [01])?"),
    ("openldap", 45, 95, "openldap", r"openldap public licen[cs]e"),
    ("postgresql", 45, 95, "postgresql", r"postgresql licen[cs]e"),
    ("curl", 45, 95, "curl", r"curl licen[cs]e"),
    ("mulan-psl", 45, 95, "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)?"),
    ("apsl", 45, 95, "apple", r"apple public source licen[cs]e"),
    ("watcom", 45, 95, "watcom", r"sybase open watcom public licen[cs]e"),
    ("lucent-pl", 45, 95, "lucent", r"lucent public licen[cs]e"),
    ("spl", 45, 95, "sun", r"sun public licen[cs]e"),
    ("sissl", 45, 95, "industry", r"sun industry standards source licen[cs]e"),
    ("eiffel", 45, 95, "eiffel", r"eiffel forum licen[cs]e"),
    ("aal", 45, 95, "assurance", r"attribution assurance licen[cs]e"),
    ("upl", 45, 95, "permissive", r"universal permissive licen[cs]e(?: v 1 0| version 1 0)?"),
    ("blueoak", 45, 95, "oak", r"blue oak model licen[cs]e"),
    ("cern-ohl", 45, 95, "hardware", r"cern open hardware licen[cs]e"),
    ("ftl", 45, 95, "freetype", r"freetype (?:project )?licen[cs]e"),
    ("ijg", 45, 90, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("imagemagick", 45, 95, "imagemagick", r"imagemagick licen[cs]e"),
    ("busl-1.1", 45, 95, "business", r"business source licen[cs]e(?: 1 1)?"),
    ("elastic", 45, 95, "elastic", r"elastic licen[cs]e(?: 2 0| v2)?"),
    ("commons-clause", 45, 95, "clause", r"commons clause licen[cs]e condition"),
    ("polyform", 45, 95, "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e"),
    ("confluent", 45, 95, "confluent", r"confluent community licen[cs]e"),
    ("openrail", 45, 95, "rail", r"(?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[cs]e)?"),
    ("llama", 45, 95, "llama", r"llama(?: [234])? community licen[cs]e(?: agreement)?"),
    ("gemma", 45, 95, "gemma", r"gemma terms of use"),
    ("public-domain", 40, 90, "public", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", 40, 90, "public", r"this (?:work|file|software|code) is in the public domain"),
    ("public-domain", 20, 60, "public", r"public domain"),
    ("public-domain", 40, 85, "protection", r"(?:is )?not subject to copyright protection"),
    ("public-domain", 35, 80, "government", r"work of the (?:united states|u s|us) government"),
    ("public-domain", 30, 80, "rights", r"no rights reserved"),
    ("proprietary", 30, 80, "reserved", r"all rights reserved"),
    ("proprietary", 40, 90, "proprietary", r"proprietary and confidential"),
    ("proprietary", 40, 90, "confidential", r"confidential and proprietary"),
    ("proprietary", 45, 95, "disassemble", r"(?:reverse engineer )?decompile or disassemble"),
    ("proprietary", 40, 90, "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \S+){0,8} is strictly prohibited"),
    ("proprietary", 40, 90, "sold", r"(?:this software|the software|software) is licensed not sold"),
    ("proprietary", 35, 85, "user", r"end user licen[cs]e agreement"),
    ("proprietary", 30, 80, "internal", r"for internal use only"),
    ("proprietary", 40, 90, "materials", r"licensed materials property of"),
    ("proprietary", 40, 90, "legend", r"restricted rights legend"),
    ("proprietary", 35, 85, "disclosure", r"non disclosure agreement"),
    ("proprietary", 35, 85, "secrets", r"contains trade secrets"),
    ("evaluation", 35, 85, "evaluation", r"(?:for evaluation (?:purposes )?only|evaluation licen[cs]e)"),
    ("shareware", 30, 80, "shareware", r"shareware"),
    ("freeware", 30, 75, "freeware", r"freeware"),
    ("non-commercial", 35, 85, "noncommercial", r"for noncommercial (?:use|purposes) only"),
    ("non-commercial", 35, 85, "non", r"for non commercial (?:use|purposes) only"),
    ("copyleft", 20, 60, "copyleft", r"copyleft"),
    ("warranty-disclaimer", 30, 70, "warranties", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", 30, 70, "warranty", r"provided as is without warranty of any kind"),
    ("warranty-disclaimer", 30, 70, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("patent-grant", 30, 75, "patent", r"royalty free (?:irrevocable )?patent licen[cs]e"),
    ("contributor-agreement", 30, 80, "contributor", r"(?:individual |corporate )?contributor licen[cs]e agreement"),
    ("contributor-agreement", 30, 80, "certificate", r"developer(?: s)? certificate of origin"),
    ("dual-licence", 25, 75, "dual", r"(?:is )?dual licen[cs]ed"),
    ("copyright", 10, 40, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", 10, 40, "copyright", r"copyright notice"),
)

#: Identifiers after an SPDX tag.
SPDX = (
    "mit", "mit 0", "apache 1 1", "apache 2 0", "gpl 1 0", "gpl 2 0", "gpl 3 0", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd", "isc", "mpl 1 1", "mpl 2 0",
    "epl 1 0", "epl 2 0", "cddl 1 0", "eupl 1 2", "unlicense", "wtfpl", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "zlib", "libpng", "bsl 1 0", "busl 1 1", "sspl 1 0", "artistic 2 0", "ofl 1 1", "odbl 1 0", "postgresql", "psf 2 0", "ncsa", "ms pl", "vim",
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    percent: int
    keywords: str
    pattern: str


def rules() -> list[Rule]:
    """All rules, in order: names in every form, then texts and SPDX tags."""
    out = [Rule(label, kind, priority, percent, keyword, form.format(name=name)) for label, keyword, name in NAMES for kind, priority, percent, form, _ in FORMS]
    out += [Rule(label, "text", priority, percent, keyword, pattern) for label, priority, percent, keyword, pattern in TEXTS]
    out += [Rule(f"spdx-{name.replace(' ', '-')}", "spdx", 60, 100, "spdx", f"spdx license identifier {name}") for name in SPDX]
    return out


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(line: Column, rule: Column) -> Column:
    """Word intervals [first, last] of a rule's matches on a normalised line."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))

    def fold(pieces: Column, found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("f"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
        step = lambda acc, x: _let(acc["at"] + _spaces(x["p"]), lambda first: F.struct((first + _spaces(x["f"])).alias("at"), F.concat(acc["spans"], F.array(F.struct(first.alias("first"), (first + _spaces(x["f"]) - 1).alias("last")))).alias("spans")))
        return F.aggregate(pairs, start, step, lambda acc: acc["spans"])

    return _let(F.regexp_extract_all(line, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast("array<struct<first:int,last:int>>")).otherwise(_let(F.split(line, pattern, -1), lambda pieces: fold(pieces, found))))


DETECTION = "array<struct<first:int,down:int,up:int,rank:int,label:string,kind:string,priority:int,percent:int,last:int>>"


def _suppressed(found: Column, levels: list[int]) -> Column:
    """Detections in order of (start, longer first, priority, rule), without those
    inside an earlier one of at least their priority.  `reach` is the furthest
    end seen so far at each priority or a higher one."""
    none = F.array(*[F.lit(-1) for _ in levels])
    start = F.struct(none.alias("reach"), F.array().cast(DETECTION).alias("kept"))
    level = lambda x: F.array_position(F.array(*[F.lit(v) for v in levels]), x["priority"]).cast("int")

    def step(acc: Column, x: Column) -> Column:
        reach = F.transform(acc["reach"], lambda r, i: F.when(i < level(x), F.greatest(r, x["last"])).otherwise(r))
        kept = F.when(F.element_at(acc["reach"], level(x)) >= x["last"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x)))
        return F.struct(reach.alias("reach"), kept.alias("kept"))

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["kept"])


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan(df: DataFrame, keep: list[str], text: str = "text", base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """keep, n_words, base matches and the detections that survive suppression."""
    table = rules()
    levels = sorted({r.priority for r in table})
    literal = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"), F.lit(r.priority).alias("priority"), F.lit(r.percent).alias("percent"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(table)])
    owners: dict[str, list[int]] = {}
    for i, r in enumerate(table):
        for k in r.keywords.split():
            owners.setdefault(k, []).append(i)
    ranks = F.create_map(*[x for k, own in sorted(owners.items()) for x in (F.lit(k), F.array(*[F.lit(i) for i in own]))])
    # a base phrase is gated by a word of its own, one that is a keyword already if there is one
    gates = sorted({*owners, *(min(p.split(), key=lambda w: (w not in owners, -len(w))) for p, _ in base)})

    phrase = " (?:" + "|".join(p for p, _ in base) + ")(?= )"

    def found(line: Column, present: Column) -> Column:
        mine = F.flatten(F.transform(present, lambda k: F.coalesce(ranks[k], F.array().cast("array<int>"))))
        hits = F.transform(F.array_sort(F.array_distinct(mine)), lambda i: F.get(literal, i))
        each = F.transform(hits, lambda r: F.transform(_spans(line, r), lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("down"), (-r["priority"]).alias("up"), r["rank"].alias("rank"), r["label"].alias("label"), r["kind"].alias("kind"), r["priority"].alias("priority"), r["percent"].alias("percent"), s["last"].alias("last"))))
        places = F.size(F.regexp_extract_all(line, F.lit(phrase), F.lit(0)))
        labels = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(f" {p} ")), F.lit(name)) for p, name in base]))
        return F.struct(
            _suppressed(F.flatten(each), levels).alias("detections"),
            places.cast("bigint").alias("n_base"),
            F.when(places > 0, _spaces(F.regexp_extract(line, f"(?s)\\A(.*?){phrase}", 1))).cast("bigint").alias("first_word"),
            F.when(places > 0, _spaces(F.regexp_extract(line, f"(?s)\\A(.*){phrase}", 1))).cast("bigint").alias("last_word"),
            labels.alias("base_labels"),
        )

    def of(words: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        present = F.array_intersect(F.array(*[F.lit(g) for g in gates]), words)
        scanned = _let(present, lambda own: F.when(F.size(own) > 0, _let(line, lambda x: found(x, own))))
        return F.struct(F.size(words).cast("bigint").alias("n_words"), scanned.alias("scan"))

    made = _let(words_of(F.coalesce(F.col(text), F.lit(""))), of)
    return df.select(*keep, made.alias("_made")).select(*keep, F.col("_made.n_words").alias("n_words"), F.col("_made.scan").alias("scan"))
