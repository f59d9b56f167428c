"""Small repositories for tests, written into a folder."""

from __future__ import annotations

PYTHON = {
    "models.py": '''
"""Domain models."""


class Base:
    id: int


class Account(Base):
    """A account account."""

    owner: str

    def __init__(self, owner: str):
        self.owner = owner

    def accepts_amount(self, plain: str) -> bool:
        return plain == self.owner


class Receipt(Base):
    value: str
''',
    "billing.py": '''
from models import Receipt, Account


def charge(owner: str, amount: str):
    """Charge a account.

    Longer text.
    """
    account = _open_account(owner)
    if not account.accepts_amount(amount):
        raise ValueError("no")
    return _issue_receipt(account)


def _open_account(owner):
    return Account(owner)


def _issue_receipt(account):
    return Receipt()


def refund(receipt):
    receipt.value.startswith("x")
''',
    "routes.py": '''
from billing import charge, refund


class app:
    @staticmethod
    def get(path):
        def decorator(fn):
            return fn
        return decorator

    @staticmethod
    def post(path):
        def decorator(fn):
            return fn
        return decorator


@app.post("/cart/buy")
def buy(owner: str, amount: str):
    """Log in."""
    return charge(owner, amount)


@app.post("/cart/undo")
def undo_purchase(receipt: str):
    refund(receipt)


@app.get("/ping")
def ping():
    return {"status": "ok"}
''',
    "test_billing.py": '''
import pytest
from billing import charge


def test_ok():
    assert charge("a", "b")


def test_bad():
    with pytest.raises(ValueError):
        charge("a", "c")


@pytest.mark.parametrize("x", [1, 2])
def test_many(x):
    charge(x, x)
''',
}
TYPESCRIPT = {
    "billing.ts": '''import { Account, Receipt, Outcome } from './types';

export class Ledger {
    async charge(owner: string, amount: string): Promise<Outcome> {
        if (!this.verify({ a: 1 }, amount)) {
            throw new Error('class Fake { f() {} }');
        }
        return { receipt: await this.issueReceipt(owner), account: null };
    }

    private async openAccount(owner: string): Promise<Account> {
        return { id: 1, owner };
    }

    private verify(account: { a: number }, plain: string): boolean {
        return /class [A-Z]{/.test(plain); // class Hidden {}
    }

    private async issueReceipt(account: Account): Promise<Receipt> {
        return { value: `tok_${account ? `class Inner { x() {} } ${1}` : ''}` };
    }

    async refund(receiptId: string): Promise<void> {
    }
}
''',
    "types.ts": '''/** interface Commented { x: number } */
export interface Account {
    id: number;
}

export interface Receipt {
    value: string;
}

export type Outcome = {
    receipt: Receipt;
    account: Account;
};
''',
}
CONFIG = {"settings.toml": '[tool]\nname = "x"\n', "data.json": '{"a": 1}\n'}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text.lstrip("\n"))
