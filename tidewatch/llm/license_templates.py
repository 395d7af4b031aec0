"""Phrases and notices that the licence scan looks for."""

# Phrases and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# The wording of public licence notices.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions"""),
    ("mit", "Released under the MIT License"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License at"""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the
        terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU Affero General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification,
        are permitted provided that the following conditions are met"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies"""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", """This work is licensed under a Creative Commons Attribution NonCommercial 4.0
        International License"""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
]
